"""Fill-in-the-middle, chat formatting and hard negatives: against brute force, and with nulls, empty and long texts, repeats, ties, empty tables, clashing columns."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeproof.llm import chat, fim, negatives

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-the-middle ---------------------------------------------------------------------------
def fim_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, None)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    out, form = (f"<S>{suf}<P>{pre}<M>{mid}", "spm") if h4 % 100 < 80 else (f"<P>{pre}<S>{suf}<M>{mid}", "psm")
    return doc_id, len(units), form, len(pre), len(mid), out


def fim_rows():
    rng = random.Random(5)
    pool = ["été", "x", "<", "<P", "P>", "<M", "日本", "a b", "\x1c", "naïve"]
    texts = ["".join(rng.choice(pool) + rng.choice((" ", "\n", "  ", "\t", "")) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    rows = list(enumerate(texts))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "has <M> inside"), (504, "w " * 20000), (505, "é" * 700_000), (506, " \t" * 9000 + "end"), (507, "ends in <"), (508, "a b<S"), (None, texts[3]), (None, texts[4]), (None, None)]
    return rows + [(504, "w " * 20000)] + [(7, texts[7])] * 3 + [(7, "another text of the same id")] + [(-9, texts[9])]


def test_fim_equals_plain_python_and_restores(spark, corpus):
    rows = fim_rows()
    docs = corpus([(i, t, "en", "s") for i, t in rows])
    placed = fim.assemble(docs)
    expected = [fim_by_hand(i, t) for i, t in rows]
    got = [tuple(r) for r in fim.verify(placed).collect()]
    assert fim.verify(placed).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(got) == Counter((*e[:5], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, rows))
    joined = Counter(tuple(r) for r in fim.texts(placed).collect())
    assert joined == Counter((e[0], e[2], e[5]) for e in expected)
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    assert fim.verify(fim.assemble(docs.limit(0))).count() == 0


def test_fim_cuts_large_documents_into_bounded_pieces(spark):
    docs = spark.createDataFrame([(i, "word " * 30_000 + "z" * 1_500_000) for i in range(6)], "doc_id long, text string")
    pieces = fim.assemble(docs, rate=100).select(F.octet_length("body").alias("b"), "n").collect()
    assert max(p.b for p in pieces) <= fim.CHUNK_BYTES + 3 and len(pieces) > 60
    assert len(fim.assemble(docs.union(docs).union(docs).coalesce(1)).collect()) == len(fim.assemble(docs.coalesce(1)).collect())  # repeats merge before the exchange


@pytest.mark.parametrize("step", [1, 2, 3, 5, 1000])
def test_fim_parser_finds_marks_over_chunk_borders(step):
    for form, body in (("psm", b"<P>a<<S>b<M<M>c<P"), ("spm", b"<S><P>p<S<M>"), ("plain", b"x<P>y"), ("psm", b"<P><S><M>")):
        parts, split = {}, fim.Splitter(form)
        for at in range(0, len(body), step):
            for part, piece in split.feed(body[at:at + step]):
                parts[part] = parts.get(part, b"") + piece
        for part, piece in split.end():
            parts[part] = parts.get(part, b"") + piece
        expected = {"psm": {"prefix": b"a<", "suffix": b"b<M", "middle": b"c<P"}, "spm": {"prefix": b"p<S"}, "plain": {"prefix": b"x<P>y"}}[form] if body != b"<P><S><M>" else {}
        assert parts == expected
    with pytest.raises(ValueError):
        list(fim.Splitter("psm").end())


# ---- chat -----------------------------------------------------------------------------------------
ROUGH = ["", " ", "hello", "[INST]", "[\\INST]", "a[/INST] b", "</s>", "<\\\\/s>", "<s>", "[", "</s", "/INST]", "[SYS] x [/SYS]", "line\nline", "[ROLE]r[/ROLE] t [END]", "日本 [\\\\END]", "\\", "[\\", "</s>[INST] ok [/INST]"]


def test_every_turn_comes_back(spark):
    rng = random.Random(6)
    for _ in range(3000):
        role = rng.choice(["system", "user", "assistant", "tool", "", "[ROLE]", "a\nb", "</s>"])
        text = "".join(rng.choice(ROUGH) for _ in range(rng.randint(0, 5)))
        shown, rounds = chat.render(role, text)
        assert [x[:2] for x in chat.parse(shown, begun=True)] == [(role, text)]
        assert chat.unescape(chat.escape(text)) == text and not chat.MARK.search(chat.escape(text))
        assert (rounds == 0) == (chat.escape(text) == text and (role in chat.AROUND or chat.escape(role) == role))


@pytest.mark.parametrize("broken", ["", "[INST] a [/INST]", "<s>[INST] a", "<s>[INST]a [/INST]", "<s> a", "<s></s>", "<s>[/INST]", "<s>[INST] a [/SYS]", "<s> a <s></s>", "<s>[ROLE]x[END]"])
def test_the_parser_refuses_what_is_not_a_conversation(broken):
    with pytest.raises(chat.Malformed):
        chat.parse(broken)


def test_conversations_round_trip(spark):
    rng = random.Random(7)
    rows = []
    for c in list(range(40)) + [None]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice([None, "plain", "".join(rng.choice(ROUGH) for _ in range(4))]), "x", 1))
    rows += [(900, t, "assistant" if t % 2 else "user", "z" * 300_000 + f"</s>{t}", "x", 1) for t in range(12)]     # several pieces
    rows += [(901, None, "user", "late", "x", 1), (901, 0, "user", "first", "x", 1), (902, 0, "user", "twice", "x", 1), (902, 0, "user", "twice", "x", 1)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    table = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string, shown string, part int").repartition(5)
    formatted = chat.format_conversations(table)
    expected = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        expected[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    kept = formatted.select("conv_id", "part", "formatted", "loss", "sources").collect()
    assert sum(k.conv_id == 900 for k in kept) > 2 and all(chat.parse(k.formatted, begun=k.part > 0) for k in kept)
    for got in (chat.read_back(formatted), chat.read_back(spark.createDataFrame(kept, formatted.schema).repartition(3), arranged=False)):
        found = {r.conv_id: r for r in got.collect()}
        assert {c: tuple(r)[1:5] for c, r in found.items()} == expected and all(r.exact for r in found.values())
        assert all(found[c].formatted_chars == sum(len(k.formatted) for k in kept if k.conv_id == c) for c in found)
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_a_changed_turn_is_noticed(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    changed = chat.format_conversations(table).withColumn("formatted", F.regexp_replace("formatted", "yes", "yet"))
    assert [r.exact for r in chat.read_back(changed).collect()] == [False]


# ---- hard negatives -------------------------------------------------------------------------------
def by_hand(rows, anchors, k=5, m=5):
    ok = {(i, l, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, l in rows if None not in (i, v, l) and len(v) and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, l, v in ok:
        if i not in anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, n) for j, n, w in ok if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == l)[:k]:
            inside = sorted(s for s in scored if s[2] != l and 80 * -p <= 100 * -s[0] <= 100 * -p)[:m]
            out |= {(i, j, r + 1, x, -p, -s) for r, (s, x, _) in enumerate(inside)}
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"slot": F.lit(1), "rank": F.lit("x"), "block": F.lit(2)})


@pytest.mark.parametrize("blocks", [2048, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 17)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(4, 19))
    rows = [(i, [float(x) for x in (centre[i % 4] * (i % 3) + rng.normal(size=19)).astype(np.float32)], int(rng.integers(0, 4))) for i in range(260)]
    rows += [(300 + i, rows[5][1], i % 3) for i in range(40)]                                          # copies: ties
    rows += [(400, None, 1), (401, [1.0, None] + [0.0] * 17, 1), (402, [float("nan")] * 19, 1), (403, rows[1][1], None), (404, [], 1), (None, rows[1][1], 1), (405, [1.0, 2.0], 1), (410, [1.0, 1.0], 1), (411, [1.0, 1.5], 2),
             (420, [0.0] * 19, 77), (421, [0.0] * 19, 77), (430, rows[9][1], 99)]
    rows.append(rows[5])                                                                               # a repeated row
    anchors = {i for i in range(0, 500, 10)}
    table = vectors_of(spark, rows)
    got = negatives.hard_negatives(table, table.filter("vec_id % 10 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == by_hand(rows, anchors)
    assert any(r[0] == 420 for r in found) and not any(r[0] == 430 for r in found)


def test_negatives_of_few_rows(spark):
    table = vectors_of(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2)])
    assert [tuple(r) for r in negatives.hard_negatives(table, table.filter("vec_id = 0")).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    assert negatives.hard_negatives(table.limit(0), table).count() == 0
    assert negatives.hard_negatives(table, table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(vectors_of(spark, [(0, [1e30], 1)]), table)


def test_the_index_leaves_out_covered_dimensions():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 64)) * np.linspace(4, 0.05, 64)
    index, asked = negatives.Index(np.arange(400), v), []
    q = rng.normal(size=(3, 64)) * np.linspace(4, 0.05, 64)
    best = np.sort(v @ q.T, axis=0)[-8]
    found = {}

    def full(i, rows, scores, t):
        found[i] = set(rows.tolist())
        asked.append(t)
        return True
    index.search(q, best, lambda i, t: t, full)
    assert all(found[i] == set(np.flatnonzero(v @ q[i] >= best[i]).tolist()) for i in range(3))
