"""The pipeline's stages, each on its own input: against brute force, with nulls, empty texts, repeats, an empty table and further columns; and the models against plain loops."""
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from placeproof.llm import language, quality, warc
from placeproof.session import work_path

WORD = re.compile("[^\x20\x09-\x0D]+")
COLUMNS = corpus_pipeline.COLUMNS
STEP = dict(corpus_pipeline.STAGES)


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = ["\n".join(line(rng.randint(12, 30)) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    near = [t.replace(t.split()[7], word(), 1) for t in base[:12]]
    return base, near, line


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(12)
    base, near, line = texts(rng)
    bad = ["!!! $$$ 999 BUY NOW!!! " * 20 + str(i) for i in range(10)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "b", len(t)) for i, t in enumerate(near)]
    rows += [(200 + i, t, "en", "a", len(t)) for i, t in enumerate(bad)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \n ", "en", None, 3), (None, line(40), "en", "a", 9), (None, base[1], "en", "a", 9)]
    rows += [(1, line(50), "en", "a", 7), (1, base[1], "en", "b", 7), (2, base[2], "en", "a", len(base[2]))]      # repeated ids: another text, the same text
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, score int").repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark):
    folder = work_path(spark, "labels")
    spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(200 + i, 0) for i in range(0, 10, 2)] + [(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def expected_groups(rows):
    """The groups of (id, text), by all pairs."""
    left, groups = list({(r.doc_id, r.text) for r in rows if shingles(r.text)}), []
    sets = {k: shingles(k[1]) for k in left}
    while left:
        group, todo = [], [left[0]]
        while todo:
            at = todo.pop()
            if at in left:
                left.remove(at)
                group.append(at)
                todo += [o for o in left if 100 * len(sets[at] & sets[o]) >= 80 * len(sets[at] | sets[o])]
        groups.append(group)
    return groups


def test_groups_keep_one_row_and_lose_no_text(spark, table):
    rows = table.select(*COLUMNS).collect()
    got = STEP["n-gram Jaccard join"](spark, table, "").collect()
    groups = expected_groups(rows)
    assert len([r for r in got if not shingles(r.text)]) == len([r for r in rows if not shingles(r.text)])
    kept = [(r.doc_id, r.text) for r in got if shingles(r.text)]
    assert len(kept) == len(set(kept)) == len(groups)
    for g in groups:
        ids = [i for i, _ in g]
        mine = [k for k in kept if k in g]
        assert len(mine) == 1 and mine[0][0] == (min(i for i in ids if i is not None) if any(i is not None for i in ids) else None)
    assert {t for i, t in kept if i == 1} == {r.text for r in rows if r.doc_id == 1}


def test_quality_stage_keeps_what_a_plain_vote_keeps(spark, table, sf_dir):
    model = quality.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(model["labels"]) == 25
    classes = quality.class_table()

    def plain(text):
        z = (quality.term_counts(text, classes) * model["weight"]) @ model["basis"]
        z = z / max(np.linalg.norm(z), 1e-12)
        near = sorted(((float(np.dot(z, v)), l) for v, l in zip(model["vectors"], model["labels"])), key=lambda x: -x[0])
        weight = [max(c, 1e-6) ** 8 for c, _ in near]
        return sum(w * l for w, (_, l) in zip(weight, near)) / sum(weight)
    got = STEP["quality classifier"](spark, table, sf_dir)
    assert got.columns == COLUMNS
    score = {(r.doc_id, r.text): plain(r.text) for r in table.collect()}
    want = sorted(str(tuple(r)) for r in table.select(*COLUMNS).collect() if score[r.doc_id, r.text] >= 0.3)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    kept = {r.doc_id for r in got.collect()}
    assert not kept & set(range(200, 210)) and set(range(40)) <= kept


def test_language_scores_are_the_kernel_ridge_of_plain_loops(spark):
    rng = random.Random(13)
    words = {"en": "the and of with house water", "de": "der und das mit haus wasser"}
    rows = [(i, " ".join(rng.choice(words[l].split()) for _ in range(9)), l) for i, l in enumerate(["en", "de"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)

    def grams(text):
        flags = np.zeros(language.CODES, np.uint8)
        language.gram_flags(text, model["table"], flags)
        return set(np.flatnonzero(flags).tolist())
    landmarks = [set(model["columns"][np.flatnonzero(model["marks"][:, j])].tolist()) for j in range(model["marks"].shape[1])]
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, text, lang in rows:
        g = grams(text)
        k = [len(g & m) / np.sqrt(len(g) * len(m)) for m in landmarks]
        s = [sum(a * b for a, b in zip(k, model["weight"][:, c])) + model["bias"][c] for c in range(2)]
        best = int(np.argmax(s))
        assert got[i].lang_pred == model["labels"][best] == lang and abs(got[i].score - min(1, max(0, (s[best] + 1) / 2))) < 1e-5


def test_copies_of_a_text_reach_the_fit_once(spark):
    docs = spark.createDataFrame([(i, "the same text in every row", "en") for i in range(3000)] + [(9000 + i, f"ein text {i} der anders ist", "de") for i in range(5)], "doc_id long, text string, lang string")
    model = language.fit(docs, training=10_000, landmarks=10_000)
    assert model["marks"].shape[1] <= 6
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    many = spark.createDataFrame([(1, f"text {i % 7}") for i in range(2000)], "doc_id long, text string")
    assert len(quality.fit(many, labels)["labels"]) == 1


def test_chunks_do_not_change_the_counts(monkeypatch):
    classes = quality.class_table()
    rng = random.Random(14)
    text = "".join(rng.choice("abc AB12.,!?\n") for _ in range(1000))
    whole = quality.term_counts(text, classes)
    flags = np.zeros(language.CODES, np.uint8)
    table = language.symbol_table({c: 1 for c in "abc"})
    language.gram_flags(text, table, flags)
    for size in (1, 2, 3, 7, 100, 999, 1000):
        monkeypatch.setattr(quality, "CHUNK", size)
        monkeypatch.setattr(language, "CHUNK", size)
        again = np.zeros(language.CODES, np.uint8)
        language.gram_flags(text, table, again)
        assert (quality.term_counts(text, classes) == whole).all() and (again == flags).all()


def test_line_stage_keeps_the_first_of_similar_lines(spark, table):
    def grams(s):
        return {s[i:i + 9] for i in range(max(1, len(s) - 8))}
    got = STEP["line dedup"](spark, table, "")
    rows, out = table.select(*COLUMNS).collect(), got.collect()
    assert got.columns == COLUMNS and len(out) == len(rows) and sum(r.text is None for r in out) <= 1
    lines = [x for _, t in {(r.doc_id, r.text) for r in out} for x in (t or "").split("\n") if x.strip()]        # repeated rows keep the same lines
    source = [x for r in rows for x in (r.text or "").split("\n") if x.strip()]
    assert set(lines) <= set(source) and len(lines) == len(set(lines))
    for x in set(source) - set(lines):                                    # what went has a similar line that stayed or went with it
        assert any(len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y)) for y in set(source) - {x})
    own = grams
    alone = [x for x in set(source) if not any(len(own(x) & own(y)) >= 0.8 * len(own(x) | own(y)) for y in set(source) - {x})]
    assert set(alone) <= set(lines)


def test_mix_and_packing_keep_every_word(spark, table):
    size = lambda t: len(WORD.findall(t or ""))
    rows = table.select(*COLUMNS).collect()
    mixed = STEP["mixing sources"](spark, table, "")
    out = mixed.collect()
    assert mixed.columns == COLUMNS
    total = {s: sum(size(r.text) for r in rows if r.source == s) for s in {r.source for r in rows}}
    order = sorted([s for s in total if s is not None]) + [s for s in total if s is None]
    weight = dict(zip(order, [3, 1, 2] * len(order)))
    goal, left = {}, 1.5 * sum(total.values())
    free = [s for s in order]
    while free:                                                           # cap at twice the source, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 2 * total[s]
            left -= goal[s]
            free.remove(s)
    longest = max(size(r.text) for r in rows)
    for s in order:
        assert abs(sum(size(r.text) for r in out if r.source == s) - goal[s]) <= longest
    for key in {(r.doc_id, r.source) for r in out}:
        own = sum(size(r.text) for r in rows if (r.doc_id, r.source) == key)
        assert sum(size(r.text) for r in out if (r.doc_id, r.source) == key) <= 2 * own
    packed = STEP["packing"](spark, mixed, "").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in packed) == sorted((str(r.doc_id), size(r.text)) for r in out)


def test_every_stage_takes_an_empty_table(spark, table, sf_dir):
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, table.limit(0), sf_dir).count() == 0, name


def test_the_whole_pipeline_runs_on_rough_rows(spark, table, sf_dir):
    folder = work_path(spark, "rough")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and not {r.doc_id for r in got} & set(range(200, 210)) and {r.doc_id for r in got} <= {r.doc_id for r in table.collect()}


def test_archives_of_no_pages_and_of_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (2, "v", None), (2, "v", None), (3, "w", "<p>")], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0
    got = warc.read_archives(spark, warc.write_archives(pages)).collect()
    found = sorted((warc.page_id(r.record_id), r.record_type, warc.page_id(r.refers_to)) for r in got)
    assert found == [(1, "revisit", 3), (1, "revisit", 3), (2, "response", None), (2, "response", None), (3, "response", None)] and all(r.kind == "record" for r in got)
