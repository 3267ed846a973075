"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from tracewarden.llm import bpe_trie, licences, maglev, minhash, packing, permutations, queries, secrets, tiff, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, n_words string"
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "the idiot said password=abcdef123 under the MIT License", "en", "s", 5, 1.0, 1, "x"),
    (2, None, None, None, None, None, None, None),
    (None, "no id here at all", "en", "s", 5, None, None, None),
    (3, "", "en", "s", 0, None, None, None),
    (4, "  \n\t ", "en", "s", 0, None, None, None),
    (5, LONG, "en", "s", 0, None, None, None),
    (6, LONG, "en", "s", 0, None, None, None),
    (7, "one two three", "en", "s", 0, None, None, None),
    (8, "ONE two  three", "en", "s", 0, None, None, None),
    (7, "one two three", "en", "s", 0, None, None, None),
    (9, "éà 日本 😀 <|endoftext|> x", "fr", "s", 0, None, None, None),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables with odd rows, and empty ones."""
    out = {}
    for name, rows in (("odd", ROWS), ("empty", [])):
        d = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        vectors = [(i, [float(i % 7 + 1), float(i % 5), 1.0], i) for i in range(45)] + [(50, None, 1), (60, [0.0, 0.0, 0.0], 1), (80, [float("nan"), 1.0, 1.0], 1), (100, [1.0, None, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (120, [1.0], 1), (1, [2.0, 1.0, 1.0], 1)]
        spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        pages = [(13, "u", "<p>a</p>"), (13, "u", "<p>a</p>"), (14, None, None), (None, "v", "x"), (2000, "w", ""), (110, "z", "hé")]
        spark.createDataFrame(pages if rows else [], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        labels = [(1, 1, 1), (7, 0, 0), (7, 0, 1), (None, 1, 1), (5, 1, None)]
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        items = [(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (2, "one two three"), (None, "no id"), (3, None), (2, "")]
        spark.createDataFrame(items if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        turns = [(1, 0, "user", "Hi."), (1, None, None, None), (None, 1, "user", ""), (2, 0, "assistant", LONG)]
        spark.createDataFrame(turns if rows else [], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        out[name] = str(d)
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] not in ("op3", "op4", "op10", "op12", "op13")])
def test_rows_stay_one_for_one(spark, folders, name):
    got = queries.QUERIES[name](spark, folders["odd"]).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    long = [tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "held_out", "slot", "shard", "component_id", "kept")) for r in got if r["doc_id"] in (5, 6)]
    assert long[0] == long[1]  # equal texts, equal values


def test_toxicity_without_text(spark, folders):
    got = {r["doc_id"]: r for r in toxicity.op1_crf_toxicity(spark, folders["odd"]).collect()}
    assert got[2]["score"] == got[3]["score"] and 0 <= got[2]["score"] <= 1
    assert got[None]["held_out"] is False and got[5]["held_out"] == (zlib.crc32(b"5") % 5 == 0)


def test_near_duplicates_on_odd_rows(spark, folders):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op6_circulant_minhash(spark, folders["odd"]).collect()]
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert (5, 5, 5, True) in got and (6, 5, 5, False) in got
    assert (8, 1, 7, False) in got and got.count((7, 1, 7, True)) == 2
    assert [x for x in got if x[0] is None][0][2:] == (None, True)


def test_one_id_with_two_texts_joins_both(spark):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    rows = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(rows).collect()}
    assert got == {(5, 3), (3, 3), (9, 3)}


def test_packing_holds_every_token(spark, folders):
    got = packing.op10_pack_nnls(spark, folders["odd"]).collect()
    total = {}
    for r in got:
        total.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert total[(2, 1)] == [(0, 1)] and total[(3, 1)] == [(0, 1)]
    for (doc, n), pieces in total.items():
        copies = 2 if doc == 7 else 1
        assert sum(length for _, length in pieces) == copies * n
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_vectors_that_take_no_part(spark, folders):
    got = permutations.op4_permutation_index(spark, folders["odd"]).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    assert not {r["vec_id"] for r in got} & {50, 60, 80, 100, 120, None}
    assert all(r["rank"] <= 20 and r["vec_id"] != r["query_id"] for r in got)
    for q in (0, 20, 40):
        assert sorted(r["rank"] for r in got if r["query_id"] == q) == list(range(1, 21))


def test_audit_of_odd_pages(spark, folders):
    got = warc.op3_merkle_warc(spark, folders["odd"]).collect()
    assert sorted((r["page_id"], r["status"], r["file"]) for r in got) == [(13, "changed", 0), (110, "changed", 0)]


def test_audit_of_a_lost_record(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(3000)], "page_id long, url string, html string")
    got = warc.audit(pages, pages.where("page_id <> 2999")).collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(2999, "missing")]
    got = warc.audit(pages.where("page_id <> 2999"), pages).collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(2999, "extra")]
    assert warc.audit(pages, pages).collect() == []


def test_audit_of_a_file_in_parts(spark):
    """More than 4096 records under one id, and in one file: a change and a loss in the middle show as themselves alone."""
    pages = spark.range(4600).selectExpr("IF(id % 3 = 0, 500, id % 1024) AS page_id", "concat('u', id) AS url", "repeat('x', CAST(id % 50 AS INT) + 1) AS html")
    worse = pages.where("url <> 'u2300'").withColumn("html", F.when(F.col("url") == "u2303", F.lit("much longer now")).otherwise(F.col("html")))
    got = warc.audit(pages, worse).collect()
    assert sorted((r["page_id"], r["status"], r["primary_sha256"] is None, r["replica_sha256"] is None) for r in got) == [(252, "missing", False, True), (255, "changed", False, False)]
    upto = lambda n: pages.where(F.substring("url", 2, 9).cast("int") < n)
    got = warc.audit(upto(4096), upto(4097)).collect()
    assert [r["status"] for r in got] == ["extra"]


def test_other_columns_stay_where_an_operator_keeps_rows(spark):
    df = spark.createDataFrame([(1, "token = abcdef0123456789", "n", 2)], "doc_id long, text string, slot string, kept long")
    placed = maglev.place(df, ["doc_id"], {"a": 1.0, "b": 2.0}).collect()[0]
    assert placed["text"] and placed["kept"] == 2 and placed["shard"] in ("a", "b") and isinstance(placed["slot"], int)
    net = secrets.fit(secrets.generated(200))
    assert secrets.redact_secrets(df, net).collect()[0]["text"] == "token = [REDACTED]"


def test_general_interfaces(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "hello <|endoftext|> world"), (None, None), (2, "")], "doc_id long, text string")
    ids = bpe_trie.bpe_encode(df, path)
    back = {r["doc_id"]: r["text"] for r in bpe_trie.bpe_decode(ids, path).collect()}
    assert back == {1: "hello <|endoftext|> world", None: "", 2: ""}
    pieces = packing.pack_tokens(df, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    assert sum(r["length"] for r in pieces) == sum(len(r["ids"]) for r in pieces)
    found = licences.scan_licences(spark.createDataFrame([(1, "x " + licences.TEMPLATES["mit"])], "doc_id long, text string")).collect()[0]
    assert found["spans"][0]["label"] == "mit" and found["spans"][0]["coverage"] == 1.0
    media = spark.createDataFrame([(1, bytearray(tiff.write_pages(b"ab" * 96 * 600))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    pages = tiff.tiff_pages(media).orderBy("doc_id", "page").collect()
    assert [(r["doc_id"], r["page"], r["error"] is None) for r in pages] == [(1, 0, True), (1, 1, True), (1, 2, True), (3, None, False)]
    assert hashlib.sha256(b"".join(bytes(r["pixels"]) for r in pages[:3])).digest() == hashlib.sha256(b"ab" * 96 * 600).digest()


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_the_pipeline_on_odd_and_empty_tables(spark, folders, name):
    """Each stage keeps the columns; of the groups of copies one document each stays, with every token once."""
    docs = spark.read.parquet(f"{folders[name]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folders[name])
        assert docs.columns == corpus_pipeline.COLUMNS
    got = corpus_pipeline.run(spark, folders[name]).collect()
    kept = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    assert sorted({r["doc_id"] for r in got}, key=str) == sorted(set(kept), key=str)
    assert kept == ([] if name == "empty" else sorted([1, 2, None, 3, 4, 5, 7, 9], key=str))


def test_copies_of_a_row_stay_once(spark):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(3, a, "", "", 1), (3, a, "", "", 1), (5, b, "", "", 1), (5, b, "", "", 1), (9, a, "", "", 1)], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [3, 5]
