import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topolane.llm import encode, packing, splitting

ALPHABET = "a1 '\n\t. 　é中😀$#sĺ re\r-_Z\u200d<|>\x85"


def test_ids_against_the_plain_encoder():
    e = encode.Encoder.get(encode.default_vocab())
    back = encode.decoder()
    rnd = random.Random(4)
    for _ in range(20000):
        s = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 16)))
        assert e.ids(s) == e.plain(s), repr(s)
    s = "".join(rnd.choice(ALPHABET) for _ in range(20000))
    assert e.ids(s) == e.plain(s) and back(e.ids(s)) == s


def test_ids_against_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = encode.Encoder.get(encode.default_vocab())
    for s in ["It's 25 o'clock", "<|endoftext|> ends", "  x\n\n\ty  ", "naïve façade — 中文と日本語", "don't'll"]:
        assert e.ids(s) == t.encode(s, add_special_tokens=False).ids


def test_null_empty_long_and_extra_columns(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "word " * 40000, None), (1, None, "x")], "doc_id bigint, text string, ids string")
    got = d.select("doc_id", encode.encode(F.col("text")).alias("t"), encode.count_tokens(F.col("text")).alias("n")).collect()
    assert [(r.doc_id, len(r.t), r.n) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 40001, 40001), (1, 0, 0)]
    assert d.limit(0).select(encode.encode(F.col("text"))).count() == 0


def test_best_fit_is_feasible_and_close():
    rnd = np.random.default_rng(1)
    s = rnd.integers(0, 2049, 5000)
    place, fill = packing.best_fit(s, 2048)
    assert np.bincount(place, weights=s).max() <= 2048 and (np.bincount(place, weights=s) == fill).all()
    assert len(fill) <= 1.02 * -(-s.sum() // 2048)


def test_pack(spark):
    rnd = random.Random(7)
    sizes = [rnd.choice([0, 1, 5, 90, 400, 999, 1000, 1001, 2500]) for _ in range(3000)]
    d = spark.createDataFrame([(i, n, "c") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, size string")
    got = packing.pack(d, 1000, per_task=400).collect()
    by_doc, by_bin, pieces = {}, {}, {}
    for r in got:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.piece_size
        by_bin[r.container_id] = by_bin.get(r.container_id, 0) + r.piece_size
        pieces.setdefault(r.doc_id, []).append(r.piece)
        assert r["size"] == "c"
    assert by_doc == dict(enumerate(sizes)) and max(by_bin.values()) <= 1000
    assert all(len(p) == max(1, -(-sizes[i] // 1000)) for i, p in pieces.items())
    assert len(by_bin) <= 1.03 * -(-sum(sizes) // 1000)
    assert all(by_bin[r.container_id] == r.container_fill for r in got)


def test_pack_of_nothing_ties_and_repeats(spark):
    d = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(d, 10).count() == 0 and packing.utilisation(packing.pack(d, 10), 10).first().containers == 0
    d = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, 10)], "doc_id bigint, n_tokens bigint")
    u = packing.utilisation(packing.pack(d, 10), 10).first()
    assert (u.containers, u.tokens, u.members, u.least) == (2, 20, 4, 2)


def check_pieces(text, most, overlap):
    size, at = splitting.Sizes(text), 0
    pieces = splitting.split_text(text, most, overlap)
    for i, (no, a, z, shared, tokens, _, over, part) in enumerate(pieces):
        assert no == i and part == text[a:z] and a <= at < z and tokens == size(a, z) and shared == (size(a, at) if a < at else 0) <= overlap
        assert over == (tokens > most) and (not over or z - a == 1 or len(part) <= 12)
        at = z
    assert at == len(text)
    return pieces


def test_pieces_cover_the_text_in_order():
    rnd = random.Random(11)
    for _ in range(300):
        text = "".join(rnd.choice(["word ", "Sentence. ", "\n", "\n\n", "# T\n", "x" * 30, "é", "中", "{", "\r\n", " ", "👩\u200d💻"]) for _ in range(rnd.randint(1, 120)))
        check_pieces(text, rnd.choice([3, 10, 40]), rnd.choice([0, 2, 8]) if True else 0)
    assert splitting.split_text("", 5, 0) == []


def test_natural_boundaries():
    text = "First one is here. Second one follows it.\n\nA new paragraph starts now. It ends."
    assert [p[7] for p in splitting.split_text(text, 16, 0)][0].endswith("it.\n\n")
    assert all(p[5] == "character" for p in splitting.split_text("x" * 200, 20, 5)[:-1])
    assert len(check_pieces("y" * 300000, 100, 10)) > 900


def test_split_table(spark):
    rows = [(1, "prose", "a b " * 200, 9), (2, "prose", "short", 9), (3, "prose", None, 9), (4, "prose", "", 9), (5, None, "a " * 400, 9), (6, "unknown", "a " * 400, 9), (1, "prose", "a b " * 200, 9)]
    d = spark.createDataFrame(rows, "evidence_key bigint, record_kind string, text string, max_size int")
    lim = spark.createDataFrame([("evidence:prose", 50, 5), ("documents:packing", 9, 0)], "applies_to string, max_size int, overlap_size int")
    got = splitting.split(d, lim).withColumn("cut", splitting.was_cut()).collect()
    assert [(r.evidence_key, len(r.pieces) > 1, r.cut) for r in got] == [(1, True, True), (2, False, False), (3, False, False), (4, False, False), (5, False, False), (6, False, False), (1, True, True)]
    assert [len(r.pieces) for r in got][1:6] == [1, 0, 0, 1, 1]
    assert splitting.split(d.limit(0), lim).count() == 0


@pytest.mark.parametrize("text", ["fn render_map(a: &str) -> Result<()> {", "🔐 secret", "a\u0301b", " \u3000x"])
def test_sizes_equal_the_column(spark, text):
    from topolane.functions.text import estimate_tokens

    assert splitting.Sizes(text)(0, len(text)) == spark.createDataFrame([(text,)], "t string").select(estimate_tokens(F.col("t")).alias("n")).first().n
