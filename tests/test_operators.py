"""Hand-written cases of the engine's own operators."""

import collections
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunks as C
from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.operators import rag
from quillspark.operators import vectors as V
from quillspark.plans import api, registry
from quillspark.sources import docx, store
from quillspark.streaming import ingest


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_cleaning(spark):
    clean = lambda t: one(spark, t, T.clean_text)
    assert clean("a\n \n \nb") == "a\n \n \nb"
    assert clean("a\n\n\n\nb") == "a\n\nb"
    assert clean("a b ﬁ é ｗ\t\tc") == "a b fi  w c"
    assert clean("\n x \n") == "x" and clean(None) is None and clean("") == ""


def test_terms(spark):
    assert one(spark, "123456789 1234567890 12345678901", T.phones) == ["1234567890"]
    assert one(spark, "AB1 A1 AB1x xAB1", T.codes) == ["AB1"]
    assert one(spark, "b@x.org a@x.org b@x.org AB1", T.sensitive_terms) == ["AB1", "a@x.org", "b@x.org"]
    assert one(spark, "It's here. Now!\nGo on", T.sentences) == ["It's here.", "Now!", "Go on"]


def words(n, k=0):
    return " ".join(f"w{k}x{i}" for i in range(n))


def chunk(spark, text, limit=450):
    rows = D.packed_chunks(spark.createDataFrame([("f", text)], "source_file string, text string"), limit=limit).orderBy("chunk_index").collect()
    return [(r["n_tokens"], r["chunk"]) for r in rows]


def test_packing(spark):
    exact = words(224) + ". " + words(224, 1) + "."
    assert [n for n, _ in chunk(spark, exact)] == [450]
    assert [n for n, _ in chunk(spark, exact + " " + words(1, 2))] == [450, 1]
    assert [n for n, _ in chunk(spark, words(901))] == [450, 451 - 226, 226]
    assert chunk(spark, "") == [] and chunk(spark, None) == [] and all(c.strip() for _, c in chunk(spark, words(1000) + ". " + words(3)))


def test_packing_is_greedy(spark):
    r = random.Random(4)
    sizes = [r.randint(1, 60) for _ in range(60)]
    text = " ".join(words(n - 1, k) + "." for k, n in enumerate(sizes))
    want, k = [], None
    for n in sizes:
        if k is None or k + n > 100:
            want.append(k := n)
        else:
            want[-1] = k = k + n
    assert [n for n, _ in chunk(spark, text, 100)] == want


def test_windows():
    r = random.Random(9)
    for _ in range(200):
        t = "".join(r.choice(["a", "bc ", ". ", "\n", "\n\n", ", ", "x" * r.randint(1, 90)]) for _ in range(r.randint(0, 120))).strip()
        got, at = C.windows(t, 60, 10), 0
        assert all(0 < len(w) <= 60 and w in t for w in got)
        assert not t or "".join(got).replace(" ", "")[:1] == t[:1]
        for w in got:
            at = t.index(w, max(0, at - 10)) if w in t[max(0, at - 10) :] else at
    assert C.windows("short") == ["short"] and C.windows("") == [] and C.windows(None) == []
    assert len(C.windows("y" * 3000)) == 3


def test_documents(spark):
    rows = spark.createDataFrame([("~$a.docx", "p1"), ("B.DOCX", "p2"), ("c.doc", "p3"), ("B.DOCX", "p9")], "file_name string, p string")
    assert [tuple(r) for r in D.latest_by_name(D.with_suffix(rows, ".docx"), "file_name", "p").collect()] == [("B.DOCX", "p9")]
    assert D.preview(rows.limit(0)).count() == 0
    meta = spark.createDataFrame([("{bad",), ("",), (None,), ('{"a":1}',)], "m string").select(D.metadata(F.col("m")).alias("m"))
    assert [r["m"] for r in meta.collect()] == [{}, {}, {}, {"a": "1"}]
    hide = lambda t: one(spark, t, lambda c: D.redact(c, ["Acme", "a.b"], ["keep"]))
    assert hide("xACMEy aXb a.b") == "x[REDACTED]y aXb [REDACTED]" and hide("nothing here") == "nothing here"


def test_embedding():
    small = V.HashedWords(8, 4)
    vec, depth = V.embed_words(["a"] * 9, small)
    assert depth == 2 and len(vec) == 8
    assert all(V.embed_words(["a"] * n, small)[1] == next(d for d in range(9) if -(-n // 2**d) <= 4) for n in range(1, 60))

    def half(text):
        if len(text.split()) > 2:
            raise V.TooLong
        if "bad" in text:
            raise ValueError
        return [1.0, 2.0]

    assert V.embed_words(["ok", "ok", "bad", "bad"], half) == ([1.0, 2.0], 1)
    assert V.embed_words(["bad"], half) == ([], 0)


def test_stats_and_store(spark, tmp_path):
    df = V.embed(spark.createDataFrame([("a b",), (" ",), (None,), ("x " * 900,)], "chunk string"))
    got = V.embed_stats(df).first()
    assert (got["total_chunks"], got["successful_embeddings"], got["empty_vectors"], got["split_depth_counts"]) == (4, 2, 2, {0: 1, 1: 1})
    path = str(tmp_path / "v")
    assert store.store_vectors(df, path) == {"inserted": 2, "skipped": 2, "total": 4}
    assert store.store_vectors(df, path, once=True)["inserted"] == 0 and spark.read.parquet(path).count() == 2


def test_python_runs_once(spark):
    """Neither an explode nor a filter on the result makes a Python function run again."""
    docs = spark.createDataFrame([("a", "one two. three")], "file_path string, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(D.char_chunks(docs)).count("ArrowEvalPython") == 2  # normal form and windows
    assert plan(V.storable(V.embed(docs, "text"))).count("ArrowEvalPython") == 1


def test_search(spark):
    rows = [(1, [1.0, 0.0]), (0, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in V.search(df, [1.0, 0.0], 9).collect()] == [0, 1, 3, 2]
    assert V.search(df, [1.0, 0.0], None).count() == 0 and V.search(df, [], 3).count() == 0
    with pytest.raises(Exception, match="lengths"):
        V.search(df, [1.0], 3).collect()
    queries = df.where("vec_id = 0").selectExpr("vec_id AS query_id", "embedding")
    assert [r["vec_id"] for r in V.search_batch(df, queries, 9).orderBy("rank").collect()] == [0, 1, 3, 2]
    plan = V.search(df, [1.0, 0.0], 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert V.search_batch(df, queries, None).count() == 0


def test_search_ranks_by_distances_as_computed(spark):
    """A vector equal to the query comes before one that differs by less than the rounding, whatever their ids."""
    df = spark.createDataFrame([(1, [math.cos(0.001), math.sin(0.001)]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in V.search(df, [1.0, 0.0], 2).select("vec_id", "distance").collect()] == [(3, 0.0), (1, 0.0)]
    batch = V.search_batch(df, spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, embedding array<double>"), 2)
    assert [(r["vec_id"], r["distance"]) for r in batch.orderBy("rank").collect()] == [(3, 0.0), (1, 0.0)]


def test_search_batch_ties_of_equal_vectors(spark):
    """Many equal vectors, in batches of odd sizes: the smallest keys win, though a matrix product may differ in the last bit."""
    r = np.random.RandomState(1)
    base = r.standard_normal((3, 64)).astype(np.float32)
    rows = [(i, base[i % 3].tolist()) for i in range(997)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = V.search_batch(df, spark.createDataFrame([(q, (base[q] + 0.01).tolist()) for q in range(3)], "query_id bigint, embedding array<float>"), 6)
    have = {q: [x["vec_id"] for x in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in range(3)}
    assert have == {q: [q + 3 * i for i in range(6)] for q in range(3)}


def test_search_batch_in_slices(spark):
    """All rows whose id is divisible by 50 as queries, 300 times over, so that they go out in two slices."""
    r = np.random.RandomState(4)
    vectors = r.standard_normal((500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    queries = df.where("vec_id % 50 = 0").crossJoin(spark.range(300)).selectExpr("vec_id * 1000 + id AS query_id", "embedding")
    have = collections.defaultdict(list)
    for row in V.search_batch(df, queries, 5, slice_mb=1).orderBy("query_id", "rank").collect():
        have[row["query_id"]].append(row["vec_id"])
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    d = np.round(1 - unit[::50] @ unit.T, 6)
    want = {i * 50: np.lexsort((np.arange(500), d[i]))[:5].tolist() for i in range(10)}
    assert have == {q * 1000 + j: v for q, v in want.items() for j in range(300)}


def test_search_batch_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 50)
    r = random.Random(3)
    vectors = [[float(r.randint(-1, 1)) for _ in range(4)] for _ in range(120)]  # many ties, some zero vectors
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").repartition(3)
    got = V.search_batch(df, df.where("vec_id < 9").selectExpr("vec_id AS query_id", "embedding"), 7)
    norm = lambda v: sum(x * x for x in v) ** 0.5

    def distance(a, b):
        return round(1 - sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 6) + 0.0 if norm(a) * norm(b) else float("inf")

    want = {q: [i for _, i in sorted((distance(vectors[q], v), i) for i, v in enumerate(vectors))[:7]] for q in range(9)}
    have = {q: [] for q in range(9)}
    for row in got.orderBy("query_id", "rank").collect():
        have[row["query_id"]].append(row["vec_id"])
    assert have == want


def test_ask(spark):
    chunks = V.embed(spark.createDataFrame([(1, "red apple pie", "{}"), (2, "blue ocean wave", "{}")], "vec_id bigint, chunk string, metadata string"))
    asked = spark.createDataFrame([(7, "apple pie"), (8, "")], "query_id bigint, query string")
    got = {r["query_id"]: r for r in rag.ask(asked, chunks, 2).collect()}
    assert got[7]["answer"] == "red apple pie" and [c["rank"] for c in got[7]["chunks"]] == [1, 2]
    assert got[8]["chunks"] == [] and got[8]["error"]
    broken = {r["query_id"]: r["answer"] for r in rag.ask(asked, chunks, 1, answer=lambda p: 1 / 0).collect()}
    assert broken[7] == rag.FAILED


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def build(body):
    p = lambda t, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style><w:style w:styleId="H"><w:name w:val="Heading"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<R><X Id="i1" Target="media/a.png"/></R>')
        z.writestr("word/media/a.png", b"png")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body(p)}<w:sectPr/></w:body></w:document>")
    return out.getvalue()


def sample():
    cell = lambda t, props="": f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = "<w:tbl><w:tr>" + cell("Head", '<w:gridSpan w:val="2"/>') + "</w:tr><w:tr>" + cell("a") + cell(" b ") + "</w:tr></w:tbl>"
    picture = '<w:p><w:r><a:blip r:embed="i1"/><a:blip r:embed="none"/></w:r></w:p>'
    return build(lambda p: p("Title", '<w:pStyle w:val="H"/>') + p("Part", '<w:pStyle w:val="H2"/>') + p("item", "<w:numPr/>") + p(" plain ") + p(" ") + picture + table)


def test_docx(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/B.DOCX").write_bytes(sample())
    (tmp_path / "in/~$a.docx").write_bytes(b"")
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    files = docx.scan(spark, str(tmp_path / "in"))
    assert {(r["file_name"], r["folder"]) for r in files.select("file_name", "folder").collect()} == {("B.DOCX", "sub"), ("bad.docx", "in")}
    got = {r["file_name"]: r for r in docx.extract(files, ocr=lambda b: "seen").collect()}
    text = got["B.DOCX"]["text"]
    assert "\n# Title\n" in text and "\n## Part\n" in text and "- item\nplain" in text
    assert "| Head | Head |\n| a | b |" in text and "> seen" in text and "\n\n\n" not in text
    assert got["bad.docx"]["text"] is None and "BadZipFile" in got["bad.docx"]["error"]
    flat = docx.blocks(files).where("error IS NULL").select(docx.flat_text(F.col("blocks")).alias("t")).first()["t"]
    assert flat.split("\n")[:5] == ["Title", "Part", "item", "plain", ""]
    assert docx.scan(spark, str(tmp_path / "missing")).count() == 0


def test_whole_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(sample())
    got = api.run(spark, str(tmp_path / "in"), str(tmp_path / "work"), ["plain"])
    assert got["inserted"] == got["total_chunks"] == 1
    assert "[REDACTED]" in spark.read.parquet(str(tmp_path / "work/chunks")).first()["chunk"]
    assert api.health(spark)["ok"]


def test_texts_json_and_stream(spark, tmp_path):
    for name, body in (("a.txt", " one. two. \n"), ("b.txt", " \n"), ("c.TXT", "x")):
        (tmp_path / name).write_text(body)
    assert [tuple(r) for r in store.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one. two.")]
    (tmp_path / "c.json").write_text('[{"source_file": "a", "chunk": "x", "embedding": [1.5]}, {"chunk": "y"}]')
    assert [(r["chunk"], r["embedding"]) for r in store.read_json(spark, str(tmp_path / "c.json")).collect()] == [("x", [1.5]), ("y", None)]
    ingest.run_available(ingest.chunk_and_embed(ingest.stream_texts(spark, str(tmp_path))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["source_file"], r["chunk"], len(r["embedding"])) for r in got] == [("a.txt", "one. two.", 64)]
    named = spark.createDataFrame([("a", "text", None), ("b", None, "e")], "file_name string, text string, error string")
    assert [r[0] for r in store.export_texts(named, str(tmp_path / "exp")).collect()] == ["a"]
    assert [(p.name, p.read_text()) for p in (tmp_path / "exp").iterdir()] == [("a.txt", "text")]
    listed = store.objects(spark, str(tmp_path)).collect()
    assert ("exp/a.txt", 4) in {(r["key"], r["length"]) for r in listed}


def test_store_operations(spark, tmp_path):
    path = str(tmp_path / "v")
    made = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [])], "chunk string, embedding array<float>")
    with pytest.raises(Exception, match="3 dimensions but 2"):
        store.store_vectors(made, path, dims=3)
    assert store.store_vectors(made, path, dims=2)["inserted"] == 1
    own = store.insert_one(spark, path, "c", [3, 4], {"source_file": "x"})
    rows = {r["chunk"]: r for r in store.read_vectors(spark, path).collect()}
    assert set(rows) == {"a", "c"} and rows["c"]["vec_id"] == own and rows["c"]["metadata"] == '{"source_file": "x"}' and rows["c"]["embedding"] == [3.0, 4.0]
    filled = store.with_defaults(spark.createDataFrame([(None,)], "chunk string"), store.chunk_defaults()).first()
    assert (filled["chunk"], filled["embedding"], filled["metadata"]) == ("", [], "{}")
    bad = store.put_files(spark.createDataFrame([("a/b", b"x"), ("a", b"y")], "key string, content binary").coalesce(1), str(tmp_path / "f")).collect()
    assert [r["error"] is None for r in bad] == [True, False]


def test_folders_and_listing(spark, tmp_path):
    keys = spark.createDataFrame([("a/",), ("a/b.docx",), ("/",)], "key string")
    assert [r["key"] for r in D.without_folders(keys).collect()] == ["a/b.docx"]
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/z.bin").write_bytes(b"123")
    assert [(r["key"], r["length"]) for r in store.objects(spark, f"file://{tmp_path}").collect()] == [("x/y/z.bin", 3)]


def test_entities(spark):
    found = one(spark, "Dr. Ada Byron of Blue Widgets GmbH and Mr Smith met in Paris, not in Parisian. AG", lambda c: T.entities(c, ["Paris", "New York"]))
    assert found == ["Dr. Ada Byron", "Mr Smith", "Blue Widgets GmbH", "Paris"]
    assert one(spark, "no names here", T.entities) == [] and one(spark, None, T.entities) is None
    docs = spark.createDataFrame([("a", "Acme Group pays."), ("b", None), ("c", "")], "file_path string, text string")
    assert [(r["file_path"], r["sensitive_terms"]) for r in D.char_chunks(docs).collect()] == [("a", ["Acme Group"])]


def test_chunk_errors_are_isolated(spark):
    def fragile(text, size, overlap):
        return [text[0], 1 / (len(text) - 3)] and [text]

    docs = spark.createDataFrame([("a", "good text"), ("b", "bad"), ("c", None)], "file_path string, text string")
    got = {r["file_path"]: (r["chunk_index"], r["text"], r["error"]) for r in D.char_chunks(docs, splitter=fragile).collect()}
    assert got["a"] == (0, "good text", None) and got["b"] == (None, None, "ZeroDivisionError: division by zero") and got["c"][2].startswith("TypeError")


def test_redaction_by_a_model(spark):
    def model():
        return lambda prompt: 1 / 0 if "bad" in prompt else prompt.split("Text:\n")[1].split("\n\nRewritten")[0].replace("Acme", "[REDACTED]")

    docs = spark.createDataFrame([("a", "Acme pays", None), ("b", "bad", None), ("c", None, None), ("d", "Acme", "unread")], "file_name string, text string, error string")
    got = {r["file_name"]: (r["text"], r["error"]) for r in rag.redact_by_model(docs, model, ["Oracle"]).collect()}
    assert got == {"a": ("[REDACTED] pays", None), "b": (None, "ZeroDivisionError: division by zero"), "c": (None, None), "d": (None, "unread")}
    assert "Leave these names as they are: Keep." in one(spark, "x", lambda c: rag.redaction_prompt(c, ["Keep"]))


def test_halving_has_no_bound(spark):
    """Sentences far above the limit times any fixed number of rounds, against the plain recursion."""

    def plain(n, limit):
        return [n] if n <= limit else plain(n // 2, limit) + plain(n - n // 2, limit)

    for n, limit in ((901, 450), (3001, 1), (1, 1), (5, 2), (4096, 3)):
        assert [k for k, _ in chunk(spark, words(n), limit)] == [x for x in packed_sizes(plain(n, limit), limit)]


def packed_sizes(sizes, limit):
    out = []
    for n in sizes:
        if out and out[-1] + n <= limit:
            out[-1] += n
        else:
            out.append(n)
    return out


def test_sentences_keep_every_sign(spark):
    assert one(spark, "a\u0001b. c\u0001d", T.sentences) == ["a\u0001b.", "c\u0001d"]
    for text in ("a b\tc", " a ", "", "\n", "don't, stop"):
        got = spark.createDataFrame([(text,)], "t string").select(T.token_count(F.col("t")), F.size(T.tokens(F.col("t"))), T.word_count(F.col("t")), F.size(T.words(F.col("t")))).first()
        assert got[0] == got[1] and got[2] == got[3]


def plain_windows(text, size, overlap):
    """The splitter written out anew: atoms as (start, end, level of the split), then greedy windows for each stretch of one split."""
    seps = ["\n\n", "\n", ".", "!", "?", ";", ",", " ", ""]

    def split(a, b, level):
        part = text[a:b]
        while seps[level] and seps[level] not in part:
            level += 1
        sep = seps[level]
        if not sep:
            return [(i, i + 1) for i in range(a, b)], None
        cuts, at = [a], a
        while (at := text.find(sep, at, b)) >= 0:
            cuts.append(at)
            at += len(sep)
        return [(x, y) for x, y in zip(cuts, cuts[1:] + [b]) if y > x], level + 1

    def stretch(atoms):
        out, first = [], 0
        for i in range(len(atoms)):
            if i > first and atoms[i][1] - atoms[first][0] > size:
                out.append((atoms[first][0], atoms[i - 1][1]))
                while first < i and (atoms[i - 1][1] - atoms[first][0] > overlap or atoms[i][1] - atoms[first][0] > size):
                    first += 1
        return [*out, (atoms[first][0], atoms[-1][1])] if atoms else out

    def walk(a, b, level):
        atoms, weaker = split(a, b, level)
        out, run = [], []
        for x in [*atoms, None]:
            if x is None or x[1] - x[0] >= size:
                out += stretch(run)
                run = []
                if x:
                    out += [x] if weaker is None else walk(*x, weaker)
            else:
                run.append(x)
        return out

    return [w for x, y in (walk(0, len(text), 0) if text else []) if (w := text[x:y].strip())]


def test_windows_equal_a_plain_splitter(spark):
    r = random.Random(21)
    for size, overlap in ((60, 10), (25, 24), (7, 0), (1, 0)):
        for _ in range(150):
            t = "".join(r.choice(["a", "bc ", ". ", "\n", "\n\n", "\n\n\n", ", ", "!", "?;", "x" * r.randint(1, 90)]) for _ in range(r.randint(0, 120)))
            assert C.windows(t, size, overlap) == plain_windows(t, size, overlap), (t, size, overlap)
    got = collections.defaultdict(list)
    for row in registry.char_chunks(spark, "/root/testdata/sf0.001").orderBy("file_path", "chunk_index").collect():
        got[row["file_path"]].append(row["text"])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", T.clean_text(F.col("text")).alias("t")).collect()
    assert {k: v for k, v in got.items()} == {str(x["doc_id"]): plain_windows(x["t"], 1200, 150) for x in docs if x["t"]}


def test_settings(monkeypatch):
    monkeypatch.setenv("X_EMPTY", "")
    assert store.setting("X_EMPTY", "d") == "" and store.setting("X_NONE", "d") == "d"
    for name in ("X_EMPTY", "X_NONE"):
        with pytest.raises(RuntimeError):
            store.setting(name)


def test_plans(spark):
    d = "/root/testdata/sf0.01"
    plan = registry.sentence_chunks(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "html" not in registry.doc_listing(spark, d)._jdf.queryExecution().executedPlan().toString()
