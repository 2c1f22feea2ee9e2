"""The training-data operators against SQL, brute force, held-out rows and hard cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import components, decontam, forest, langid, mixing, pii, quality, secretscan, shards, topk, urllists
from quillspark.llm import queries as Q
from quillspark.llm.common import Hashes

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


CLASH = "size int, shard int, kind string, target double, source_size int, digest string, rep int, label int, score double, rank int, position int, taken int, comp int, a int, b int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i * 7919 % 9973}" for i in range(60_000))
    rows = [(1, "one two three four five six seven", "en", "a", 3), (1, "one two three four five six seven", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "b", 0)]
    rows += [(None, "one two three four five six seven", "en", None, 1), (None, None, None, None, None), (4, long, None, "b", 9), (5, long + " tail", "fr", "c", 9), (6, "!!! ???", "de", "c", 1), (7, "ok", "en", "é", 1)]
    more = (1, 2, "x", 0.5, 3, "d", 4, 5, 0.1, 6, 7, 8, 9, 10, 11)
    return spark.createDataFrame([r + more for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    same(spark, duck, Q.queries()[name], Q.oracle_sql()[name])


def test_language(spark, hard, none):
    out = Q.op1_language(spark, f"{DATA}/sf0.01").toPandas()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    held = out[out.held_out]
    assert len(out) == 1000 and all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out))
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.95 and out.score.between(0, 1).all()
    model = langid.train(hard)
    found = {(r["doc_id"], r["best_lang"]) for r in langid.identify(hard, model).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (None, "und")} <= found and (7, "und") not in found
    assert langid.identify(none, langid.train(none)).count() == 0
    assert {r["best_lang"] for r in langid.identify(hard, langid.train(none)).collect()} == {"und"}


def test_training_reads_whole_texts(spark):
    """A long text teaches its middle and end too; a short one teaches all."""
    part = lambda w, n: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(n))
    long = " ".join(part(w, 8000) for w in ("start", "middle", "finish"))
    rows = [(1, long, "aa"), (2, part("brief", 100), "bb"), (3, part("first", 1000) + " " + part("last", 1000), "cc")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    found = dict(zip(model.names, model.dictionaries))
    assert all(w in found["aa"] for w in (b"start", b"middle", b"finish")) and found["bb"].count(b"brief") == 100
    assert found["cc"].count(b"first") > 800 and found["cc"].count(b"last") > 800
    assert len(found["aa"]) <= 98_304 // 8 + langid.PIECES


def test_language_is_that_of_the_smallest_encoding(texts):
    """The choice against a plain loop over dictionaries; every block at one level, whatever its length."""
    import zstandard

    r = random.Random(3)
    groups = [[" ".join("".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(300)) for _ in range(4)] for a in ("abcdef", "defghi", "uvwxyz")]
    model = langid.Languages(["x", "y", "z"], [" ".join(g).encode() for g in groups])

    def size(raw, block):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False).compress(block + langid.PAD))

    sample = [g[0][a : a + n] for g in groups for a, n in ((5, 30), (50, 400), (0, 900))] + [(g[1] + " ") * 9 for g in groups]
    got = langid.scorer(model, 0.02)(sample)[0]
    for t, name in zip(sample, got, strict=True):
        raw = langid.letters(t).encode()
        sizes = [sum(size(d, raw[at : at + langid.BLOCK]) for at in range(0, len(raw), langid.BLOCK)) for d in model.dictionaries]
        assert name == model.names[sizes.index(min(sizes))]


def test_training_shares_out_its_bytes():
    assert langid.level_of([5, 9, 100, 100], 54) == 20 and langid.level_of([5, 9], 100) == 9 and langid.level_of([], 9) == 0
    assert langid.spread(["ééé", "abc"], 6) == "é abc"


def plain_overlap(own, words, window, least):
    """Whether some diagonal has a window that agrees enough."""
    w = min(window, len(own))
    return any(sum(own[s + i] == words[t + i] for i in range(w)) >= least * w for s in range(len(own) - w + 1) for t in range(len(words) - w + 1))


def test_decontamination_brute(spark, texts):
    items = [r for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = decontam.Index([(r["item_id"], r["text"]) for r in items], decontam.MASKS)
    tok = lambda t: decontam.WORD.findall(t.lower())
    r = random.Random(3)
    for item in items[:12]:
        own = tok(item["text"])
        for subs in (0, 1, 2):
            words = list(own[:13])
            for i in r.sample(range(len(words)), subs):
                words[i] = "zz"
            text = "before it " + " ".join(words) + " and after"
            assert (item["item_id"] in {index.ids[k] for k in index.overlaps(text, 13, 0.8)}) == plain_overlap(own, tok(text), 13, 0.8)
    for i in sorted(texts)[:25]:
        t = " ".join(tok(texts[i])[:160])
        assert {index.ids[k] for k in index.overlaps(t, 13, 0.8)} == {x["item_id"] for x in items if plain_overlap(tok(x["text"]), t.split(), 13, 0.8)}


def plain_hits(index, words):
    out = collections.defaultdict(set)
    for mask, (keys, item, pos) in zip(index.masks, index.seeds, strict=True):
        at, h = decontam.seed_keys(words, mask)
        for a, x in zip(at.tolist(), h.tolist(), strict=True):
            for k in np.flatnonzero(keys == x):
                out[int(item[k])].add(a - int(pos[k]))
    return {i: sorted(d) for i, d in out.items()}


@pytest.mark.parametrize("pairs", [1 << 20, 64, 4000])
def test_diagonals_of_repeated_words(monkeypatch, pairs):
    """Diagonals by expansion, in pieces and by shifted bits against all pairs of positions."""
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    r = random.Random(pairs)
    for _ in range(12):
        items = [(i, " ".join(r.choice("aab" if i % 2 else "abcdefg") for _ in range(r.randint(1, 70)))) for i in range(5)]
        index = decontam.Index(items, decontam.MASKS)
        words = np.array([index.words.get(r.choice("aaabz" if r.random() < 0.7 else "abcdefg"), 0) for _ in range(r.randint(0, 150))], np.int64)
        assert {i: d.tolist() for i, d in index.hits(words).items()} == plain_hits(index, words)


def test_repeated_words_take_little_memory():
    """20,000 x 20,000 equal words, and words in turn, in seconds and under 500 MB."""
    import tracemalloc

    for text in ("same " * 20_000, "one two " * 10_000):
        start = time.perf_counter()
        tracemalloc.start()
        index = decontam.Index([(1, text)], decontam.MASKS)
        assert index.overlaps("start " + text, 10, 0.8)[0] == (1, 20_001, 20_000)
        assert tracemalloc.get_traced_memory()[1] < 500e6 and time.perf_counter() - start < 20
        tracemalloc.stop()


@pytest.mark.parametrize("n", range(6, 13))
def test_items_of_six_to_twelve_words(n):
    """Every set of substituted words that the share allows, against all alignments."""
    own = [f"w{i}" for i in range(n)]
    index = decontam.Index([(1, " ".join(own))], decontam.MASKS, 10, 0.8)
    for bits in range(1 << n):
        if bits.bit_count() <= 4:
            words = ["a", *("zz" if bits >> i & 1 else w for i, w in enumerate(own)), "b"]
            assert bool(index.overlaps(" ".join(words), 10, 0.8)) == plain_overlap(own, words, 10, 0.8), words


def agreeing(words, own, window):
    """Whether any alignment of whole texts has a window that agrees to 0.8."""
    w = min(window, len(own))
    x, y = np.nonzero(words[:, None] == own[None, :])
    shifts, n = np.unique(x - y, return_counts=True)
    for d in shifts[n >= 0.8 * w - 1e-9].tolist():
        a, b = max(0, -d), min(len(own), len(words) - d)
        same = np.concatenate([[0], np.cumsum(own[a:b] == words[a + d : b + d])])
        if b - a >= w and (same[w:] - same[:-w] >= 0.8 * w - 1e-9).any():
            return True
    return False


def test_query_equals_brute_force_on_whole_texts(spark, texts):
    """The registered query, window of ten words, against every alignment of every text and item."""
    numbers = collections.defaultdict(lambda: len(numbers))
    code = lambda t: np.array([numbers[w] for w in decontam.WORD.findall(t.lower())], np.int64)
    items = {r["item_id"]: code(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want, known = set(), {}
    for i, t in texts.items():
        for k, own in items.items():
            if i not in known:
                known[i] = code(t)
            if agreeing(known[i], own, 10):
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in Q.op2_decontaminate(spark, SMALL).collect()} == want and len(want) >= 3


def test_masks_find_every_ten_words_with_two_substituted():
    item = decontam.Index([(1, " ".join(f"w{i}" for i in range(10)))], decontam.MASKS)
    for a in range(10):
        for b in range(a):
            text = " ".join("zz" if i in (a, b) else f"w{i}" for i in range(10))
            assert item.overlaps(text, 10, 0.8)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_decontamination_of_short_items(n, least):
    """Items of two to five words with every set of words substituted, against all alignments."""
    own = [f"w{i}" for i in range(n)]
    index = decontam.Index([(1, " ".join(own))], decontam.MASKS, 10, least)
    for bits in range(1 << n):
        words = ["a", *("zz" if bits >> i & 1 else w for i, w in enumerate(own)), "b"]
        assert bool(index.overlaps(" ".join(words), 10, least)) == plain_overlap(own, words, 10, least), words


def test_decontamination_cases(spark, hard, none):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "one"), (None, "x y z w q")], "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"], r["n_same"]) for r in decontam.contaminated(hard, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 6), (1, 1, 6), (None, 1, 6)], key=str)
    assert decontam.decontaminate(hard, bench).count() == hard.count() - 3
    assert decontam.decontaminate(hard, bench).columns == hard.columns
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(hard, bench.limit(0)).count() == 0
    sliced = decontam.contaminated(hard, bench.union(spark.createDataFrame([(9, "pad " * 600_000)], bench.schema)), slice_mb=1)
    assert sorted(r["doc_id"] or 0 for r in sliced.collect()) == [0, 1, 1]


def test_url_lists(spark):
    events = spark.createDataFrame([("l", "A.com", "add", 3), ("l", "a.com", "remove", 5), ("l", "a.com", "add", 5), ("m", "a.com/x", "add", 1), (None, "a.com", "add", 0), ("l", "b.com", "remove", 2)], "list string, entry string, action string, at int")
    assert {tuple(r) for r in urllists.intervals(events).collect()} == {("l", "a.com", 3, 5), ("m", "a.com/x", 1, None)}
    rows = [(1, "http://u@W.a.com:80/x/y", 4), (2, "https://a.com/z", 3), (3, "https://a.com", 5), (4, "https://xa.com/x", 4), (5, None, 4), (6, "nope", 4), (7, "https://a.com/x", None), (1, "http://u@W.a.com:80/x/y", 4)]
    caps = spark.createDataFrame(rows, "page_id int, url string, fetched int").selectExpr("*", "1 AS list", "2 AS entry", "3 AS host")
    got = sorted((r["page_id"], r["host"], r["lists"], r["n_entries"], r["blocked"]) for r in urllists.evaluate(caps, events, ["page_id"]).na.fill("-").collect())
    a = (1, "w.a.com", "l,m", 2, True)
    assert got == [a, a, (2, "a.com", "l", 1, True), (3, "a.com", "", 0, False), (4, "xa.com", "", 0, False), (5, "-", "", 0, False), (6, "-", "", 0, False), (7, "a.com", "", 0, False)]
    assert urllists.evaluate(caps.limit(0), events, ["page_id"]).count() == 0 and urllists.evaluate(caps, events.limit(0), ["page_id"]).where("blocked").count() == 0


def plain_pii(text):
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, *s) for k in pii.KINDS for s in out[k]]


def test_pii_base_equals_plain_patterns(texts):
    r = random.Random(1)
    parts = ["a@b.c", "@", ".", "+1 (743) 555-3824", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", " ", "-", "x", "é", "+", "(", "12", "a.b@c-d.e.f@g.h", "1" * 20]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(t) == plain_pii(t), t
    for t in texts.values():
        assert pii.base_spans(t) == plain_pii(t)


def test_pii_disguises():
    x = "mail bob (at) example [dot] com or ann at site dot co dot uk, bаd@еxample.com plus one five five five zero one two three four five six; look at www.example.com. one nine two dot one six eight dot one dot one ｊｏｅ＠ｘ．ｏｒｇ"
    base = pii.base_spans(x)
    assert {x[a:b] for _, a, b in pii.added_spans(x, base)} == {"bob (at) example [dot] com", "ann at site dot co dot uk", "bаd@еxample.com", "plus one five five five zero one two three four five six", "one nine two dot one six eight dot one dot one", "ｊｏｅ＠ｘ．ｏｒｇ"}
    for clean in ("Meet me at the dot on the map.", "We sat at home.", "one two three", "Look at example.com today"):
        assert pii.added_spans(clean, pii.base_spans(clean)) == []


def test_pii_partly_disguised():
    added = lambda x: [x[a:b] for _, a, b in pii.added_spans(x, pii.base_spans(x))]
    numbers = ("4111 1111 1111 11 one one", "4111-1111-one111-1111", "192.168.one.one", "10.0.zero.one", "+1 seven four three 555 3824", "plus one 743 555 3824", "plus 1 743 555 3824", "+49 (one seven six) 1234567")
    hosts = ("ann at startup dot co", "ann at mail dot example dot xyz", "ann at mail dot example dot ie", "ann at mail dot example dot online", "ann at mail dot example.com", "ann at one dot com")
    for x in numbers + hosts:
        assert added(x) == [x] and added(f"In 2024 it was {x}, she said.") == [x], x
    for clean in ("le 12 sept 2024 un 3", "arrived at some point on Monday", "12 of 34 one 5 at six", "call +1 743 555 3824 one of these days", "\u017fix one 3"):
        assert added(clean) == [], clean
    assert len(added("a at b dot c, " * 20_000)) == 20_000


def disguised(r):
    """A disguise of a made identifier, by a random choice of the ways that the docstrings name."""
    kind = r.choice(["email", "ip", "card", "phone"])
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        word = lambda: "".join(r.choice("bcdfgkmnpqrtvwz") for _ in range(6))
        way = r.randrange(4)
        if way == 0:
            return kind, f"{word()}{r.choice([' (at) ', '[at]', ' @ ', '_at_'])}{word()}{r.choice([' [dot] ', '(dot)', '_dot_'])}com"
        if way == 1:
            return kind, f"{word()} at {word()} dot {word()} dot org"
        if way == 2:
            return kind, f"{word()}@{word()}.com".translate(str.maketrans("co", "со"))
        return kind, "".join(chr(ord(c) + 0xFEE0) for c in f"{word()}@{word()}.net")
    if kind == "ip":
        parts = [str(r.randint(1, 9)) for _ in range(4)]
        return kind, r.choice([" dot ".join(names[int(x)] for x in parts), ".".join([*parts[:2], names[int(parts[2])], parts[3]])])
    if kind == "card":
        d = "4" + digits(14)
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        at = r.randrange(4) * 4
        return kind, " ".join(" ".join(names[int(c)] for c in d[i : i + 4]) if i == at else d[i : i + 4] for i in range(0, 16, 4))
    d = digits(9)
    return kind, r.choice(["plus " + " ".join(names[int(c)] for c in "1" + d), f"plus 1 {d[:3]} {d[3:6]} {d[6:]}", f"+1 {' '.join(names[int(c)] for c in d[:3])} {d[3:6]} {d[6:]}"])


def test_disguises_are_found_where_they_were_put():
    """A generator of disguises with known kinds and spans, between plain words."""
    r = random.Random(31)
    plain = ["the house was", "and so they went", "nothing more", "quite early", "she said it"]
    missed = collections.Counter()
    for _ in range(600):
        text, want = "", []
        for _ in range(r.randint(1, 4)):
            text += r.choice(plain) + "; "
            kind, own = disguised(r)
            want.append((kind, len(text), len(text) + len(own)))
            text += own + " ; "
        got = set(pii.added_spans(text, pii.base_spans(text)))
        for w in want:
            missed[w[0], w in got] += 1
        assert all(any(k == x and a >= s and b <= e or a <= s and e <= b for x, s, e in want) for k, a, b in got), text
    assert all(missed[k, False] <= 0.02 * missed[k, True] for k in pii.KINDS), missed


def test_many_disguises_in_one_text_take_linear_time():
    start = time.perf_counter()
    text = "ann (at) mail dot com, one nine two dot one six eight dot one dot one; " * 25_000
    assert len(pii.added_spans(text, pii.base_spans(text))) == 50_000 and time.perf_counter() - start < 60


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=secretscan.order)


def test_secrets(texts):
    r = random.Random(2)
    parts = ['PassWord = "abcdef1"', "token:", "api_key=", "AKIA" + "Q" * 16, "AKIA12", "0a" * 12, "deadbeef", " ", '"', "x", "secret", ":", "kJ8s0dKq2Lw9ZxR4tYb7"]
    for t in [*texts.values(), *("".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(4000))]:
        assert secretscan.base_spans(t) == plain_secrets(t), t
    coder = secretscan.vocabulary(secretscan.VOCABULARY)
    hit = lambda s: bool(secretscan.random_spans(s, [], coder, 2.2))
    assert hit("see kJ8s0dKq2Lw9ZxR4tYb7 here") and hit("wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzLKEY")
    assert not any(map(hit, ("550e8400-e29b-41d4-a716-446655440000", "getHTTPResponseCode200Handler", "my_long_variable_name_2024_v2", "internationalization of things")))


@pytest.mark.parametrize("letters", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_random_keys(letters):
    """The ratio decides: keys of base32, of one case and of letters only are found; words are not, nor do they cover for a key."""
    r, coder = random.Random(6), secretscan.vocabulary(secretscan.VOCABULARY)
    hit = lambda s: bool(secretscan.random_spans(s, [], coder, 2.2))
    for n in (20, 32):
        keys = ["".join(r.choice(letters) for _ in range(n)) for _ in range(200)]
        assert [k for k in keys if not hit(k)] == [k for k in keys if n >= 2.2 * len(coder.encode_ordinary(k))]
    assert hit("configuration-a1b2c3d4e5f6g7h8") and hit("user_id_7Kq2Lw9ZxR4tYb")
    assert not any(map(hit, ("Donaudampfschifffahrtsgesellschaft", "MAX_RETRY_COUNT_2_DEFAULT", "AbstractSingletonProxyFactoryBean", "usr/local/lib/python3/dist-packages", "a" * 40 + "B")))


def test_hostile_runs_take_linear_time():
    """Runs that look like identifiers for long, of 20 to 100,000 characters."""
    coder, r = secretscan.vocabulary(secretscan.VOCABULARY), random.Random(8)
    start = time.perf_counter()
    for n in [*range(20, 120)] * 90 + [1000] * 900 + [10_000] * 90 + [100_000] * 9:
        tail = "".join(r.choice(["1y2z3w4v5", "A1b", "_", "-x9"]) for _ in range(3))
        secretscan.random_spans("x" * (n - len(tail)) + tail, [], coder, 2.2)
    assert time.perf_counter() - start < 60
    for n in (50, 199, 200, 5000):
        assert not secretscan.random_spans("_".join(["value", "name", "count"] * n), [], coder, 2.2)


def test_added_secrets_equal_a_plain_rule(texts):
    """Every run of key characters, tested by itself against all base spans."""
    coder, r = secretscan.vocabulary(secretscan.VOCABULARY), random.Random(12)
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz234567") for _ in range(r.randint(10, 40)))
    made = [" ".join(r.choice([key, lambda: "some words here", lambda: "password=" + key(), lambda: "0a" * 14, lambda: "AKIA" + "Q7" * 9])() for _ in range(30)) for _ in range(60)]
    found = 0
    for t in [*texts.values(), *made]:
        base = plain_secrets(t)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
            s = m[0]
            known = re.fullmatch("[0-9a-fA-F-]+", s) or any(x < m.end() and m.start() < y for _, x, y in base)
            if len(s) >= 20 and not known and len(s) / len(coder.encode_ordinary(s)) < 2.2 and not secretscan.identifier(s, coder, 2.2):
                want.append(("random", *m.span()))
        assert secretscan.random_spans(t, base, coder, 2.2) == want
        found += len(want)
    assert found > 200


@pytest.mark.parametrize("op,n", [(pii.find_pii, 4), (secretscan.find_secrets, 3)])
def test_scans_of_hard_rows(hard, none, op, n):
    out = op(hard).toPandas()
    assert len(out) == 10 and op(none).count() == 0
    assert set(out.base_sha256) == {hashlib.sha256(b"").hexdigest()} and set(out.spans) == {""}
    assert op(hard).columns[1:n] == [f"n_{k}" for k in (pii.KINDS if n == 4 else secretscan.KINDS)][: n - 1]


def test_topk_large_components(spark):
    """Components of 2^15 and far more, beside ordinary ones, against Python's integers."""
    r = np.random.RandomState(7)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, (r.standard_normal(8) * 2.0 ** (15 + i % 6)).tolist()) for i in range(40)]
    rows += [(400, [2.0**22] + [0.0] * 7), (401, [0.0] * 7 + [-(2.0**56)]), (402, [-(2.0**22)] + [1.0] * 7)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows = [(i, v[:7] + [0.0]) if i % 50 == 0 else (i, v) for i, v in rows]
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    got = collections.defaultdict(list)
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), k=4).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((-x["score"], x["vec_id"]))
    want = {q: sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4] for q in whole if q % 50 == 0}
    assert got == want and len(want) == 8


def test_topk_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]), (7, []), (2, [1.0, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "2 AS score", "3 AS query_id")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, k=3).collect()}
    assert got[(0, 1)] == (1, 65536) and got[(0, 2)] == got[(0, 3)] == (2, 65536) and got[(100, 1)] == (0, 0) and got[(50, 3)] == (2, 32768)
    assert len(got) == 9 and topk.top_k(df.limit(0)).count() == 0


def test_topk_of_repeated_query_ids(spark):
    """Each row with a query's id is a query of its own; none of them is a candidate for the others."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (3, [0.25, 0.25])]
    got = collections.Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=2).collect())
    assert got == {(50, 1, 1, 32768): 2, (50, 1, 2, 32768): 1, (50, 2, 3, 16384): 3}


def test_topk_block_equals_all_scores():
    r = np.random.RandomState(3)
    for dims, skew in ((1, 1.0), (5, 3.0), (16, 0.3)):
        v = np.floor(r.standard_normal((700, dims)) * 200 * np.arange(1, dims + 1) ** -skew).astype(np.int64)
        q, ids, best = v[:9].copy(), r.permutation(700), topk.Best(9, 5)
        q[3] = 0
        for at in range(0, 700, 100):
            topk.search_block(q, ids[:9], v[at : at + 100], ids[at : at + 100], best, np.arange(9))
        for j in range(9):
            want = sorted((-int(x @ q[j]), int(i)) for x, i in zip(v, ids, strict=True) if i != ids[j])[:5]
            assert [(-int(s), int(i)) for s, i in zip(best.score[j], best.id[j], strict=True)] == want


def test_topk_stops_early():
    r = np.random.RandomState(0)
    v = r.randint(-5, 6, (4000, 3)) * np.array([100, 1, 1])
    v[7] = [900, 50, 50]
    best = topk.Best(1, 1)
    assert topk.search_block(np.array([[10, 1, 1]]), np.array([-1]), v, np.arange(4000), best, np.array([0])) < 2000 and best.id[0][0] == 7


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


def brute_links(texts):
    known = Hashes()
    sets = {i: set(forest.ngrams(t, 5, known).tolist()) for i, t in texts.items()}
    links, root = collections.Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            if jaccard(sets[i], sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: links[i] for i in ids}, {i: find(i) for i in ids}


def test_jaccard_brute(spark, docs, texts):
    r, base = random.Random(5), {k: v for k, v in texts.items() if len(v) < 4000}
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    own = [word() for _ in range(150)]
    for k in range(160):  # one large group of near copies, in more than one block
        x = list(own)
        for i in r.sample(range(150), r.randint(0, 3)):
            x[i] = word()
        base[10_000 + k] = " ".join(x)
    df = spark.createDataFrame(list(base.items()), "doc_id bigint, text string")
    out = forest.jaccard_join(df, block_docs=48).toPandas()
    links, classes = brute_links(base)
    assert dict(zip(out.doc_id, out.n_links, strict=True)) == links
    assert dict(zip(out.doc_id, out.class_id, strict=True)) == classes
    kept = {r["doc_id"] for r in forest.one_of_each(df).collect()}
    assert kept == {i for i, c in classes.items() if i == c}


def test_jaccard_hard(hard, none):
    out = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["n_copies"]) for r in forest.jaccard_join(hard).collect())
    assert out == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 0, 0), (3, 3, 0, 0), (4, 4, 1, 0), (5, 4, 1, 0), (6, 6, 0, 0), (7, 7, 0, 0)]
    kept = forest.one_of_each(hard)
    assert kept.columns == hard.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7]
    assert forest.jaccard_join(none).count() == 0 and forest.one_of_each(none).count() == 0


def test_jaccard_judges_texts_that_share_an_id_each_by_itself(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(3, one), (7, one + " tail"), (7, two), (9, two + " tail"), (5, three), (5, three + " tail"), (5, three + " tail"), (8, three)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in forest.jaccard_join(df).collect())
    assert got == {(3, 3, 1): 1, (7, 3, 1): 1, (7, 7, 1): 1, (9, 7, 1): 1, (5, 5, 3): 3, (8, 5, 3): 1}
    kept = [tuple(r) for r in forest.one_of_each(df).collect()]
    assert sorted(x for x in kept if x[0] != 5) == [(3, one), (7, two)]
    assert len([x for x in kept if x[0] == 5]) == 1 and len(kept) == 3


def test_jaccard_recall_at_whole_tables(spark):
    """Every link of sf0.01 by brute force over inverted n-grams."""
    d = f"{DATA}/sf0.01"
    texts, known = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}, Hashes()
    sets = {i: forest.ngrams(t, 5, known) for i, t in texts.items()}
    where = collections.defaultdict(list)
    for i, g in sets.items():
        for x in g.tolist():
            where[x].append(i)
    common = collections.Counter((i, j) for ids in where.values() if len(ids) > 1 for k, i in enumerate(ids) for j in ids[k + 1 :])
    links = collections.Counter()
    for (i, j), n in common.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[i] += 1
            links[j] += 1
    out = {r["doc_id"]: r["n_links"] for r in Q.op6_jaccard(spark, d).collect()}
    assert out == {i: links[i] for i in texts} and sum(links.values()) > 100


def test_link_counts_equal_plain_pairs():
    """Within blocks and between two, with grams that few, many or all sets share."""
    r = np.random.RandomState(5)
    base = r.randint(0, 1 << 62, 90).astype(np.uint64)
    for m, split in ((1, 0), (7, 0), (60, 0), (60, 20), (61, 1), (300, 130)):
        sets = []
        for k in range(m):
            keep = base[r.rand(90) > (0.08 if k % 3 else 0.5)]
            sets.append(np.unique(np.concatenate([keep, r.randint(0, 40, r.randint(1, 12)).astype(np.uint64), r.randint(0, 1 << 62, r.randint(0, 3)).astype(np.uint64)])))
        weight = r.randint(1, 5, (m, 2))
        links, root = forest.link_counts(sets, weight, split, 0.8)
        want, parent = np.zeros((m, 2), np.int64), list(range(m))
        plain = [set(x.tolist()) for x in sets]
        for i in range(m):
            for j in range(i + 1, m):
                if (not split or i < split <= j) and jaccard(plain[i], plain[j]) >= 0.8:
                    want[i] += weight[j]
                    want[j] += weight[i]
                    a, b = sorted((parent[i], parent[j]))
                    parent = [a if x == b else x for x in parent]
        assert (links == want).all() and root.tolist() == parent


def test_prefixes_are_shortened_until_the_recall_is_reached():
    """By the texts' own runs: short ones first in the order of the trees, hot ones only where those don't do."""
    trees, full, least = 24, 7, 4
    r = np.random.RandomState(1)
    sizes = np.ones((50, trees, 4), np.int32)
    for k in range(50):
        hot = r.permutation(trees)[: k // 2]
        sizes[k, hot] = r.randint(65, 5000, (len(hot), 1)) * np.array([8, 4, 2, 1])
    depth = forest.shortened(sizes, full, least, 0.8, 0.9999, 64)
    missed = (1 - 0.8 ** depth.astype(float)).prod(axis=1)
    assert (missed <= 1e-4 * 1.0001).all() and depth.min() >= least and depth.max() == full
    hot = sizes[:, :, 0] > 64
    assert (depth[10:20][hot[10:20]] == full).all() and (depth[10:20][~hot[10:20]] < full).all()
    # One value more anywhere would miss the target.
    assert (missed[:10] / (1 - 0.8 ** depth[:10].min(axis=1)) * (1 - 0.8 ** (depth[:10].min(axis=1) + 1)) > 1e-4).all()


def test_trie_of_many_partitions_equals_one(spark):
    """Runs that borders of partitions cut still join all their members."""
    r = np.random.RandomState(9)
    rows = []
    for k in range(400):
        digest = k.to_bytes(16, "big")
        for tree in range(3):
            label = np.concatenate([[k // 40 if tree == 0 else r.randint(0, 200)], r.randint(0, 2 if tree == 0 else 50, 6)]).astype(">u2")
            rows.append((tree, label.tobytes(), digest))
    df = spark.createDataFrame(rows, "tree int, label binary, digest binary")
    found = []
    for parts in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        held = forest.Held()
        near = forest.matched(df, 1200, 7, 1)
        edges = forest.meetings(near.select("tree", "label", "digest", F.lit(1).alias("depth")), 1200, 7, 1, held).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        parent = {k: k for k in range(400)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((find(int.from_bytes(a, "big")), find(int.from_bytes(b, "big"))))
            parent[y] = x
        found.append([find(k) for k in range(400)])
        held.release()
    heads = collections.defaultdict(list)
    for tree, label, digest in rows:
        heads[tree, label[:2]].append(int.from_bytes(digest, "big"))
    plain = {k: k for k in range(400)}
    changed = True
    while changed:
        changed = False
        for ks in heads.values():
            low = min(plain[k] for k in ks)
            changed |= any(plain[k] != low for k in ks)
            plain |= dict.fromkeys(ks, low)
    assert found[0] == found[1] == [plain[k] for k in range(400)]


def test_recall_of_the_adapted_depth():
    d = forest.adapted_depth(6, 20, 0.8, 0.999)
    assert forest.chance(d, 20, 0.8) >= 0.999 > forest.chance(d + 1, 20, 0.8)


def test_mix_of_repeated_ids_agrees(spark):
    """Texts of equal length that share an id: reruns use the same ones, whatever the order of rows."""
    rows = [(i % 5, f"w{i} " * 7, "en", "s" if i % 4 else "t", 7) for i in range(60)]
    runs = [sorted((r["text"], r["source"]) for r in mixing.mixed(spark.createDataFrame(rows[::k], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)).collect()) for k in (1, -1)]
    assert runs[0] == runs[1] and len(set(runs[0])) < 60


def test_tables_are_dropped(spark):
    from quillspark.llm import common

    made = common.Tables()
    table = made(spark.range(10).toDF("x"), "dropped", 10)
    files, at = common._path(spark, next(iter(made.paths.values()))[1])
    assert table.count() == 10 and files.exists(at) and table.rdd.getNumPartitions() == 1
    made.drop(table, None)
    assert not files.exists(at) and not made.paths


def test_components_of_a_long_path_and_a_star(spark):
    r = random.Random(4)
    names = list(range(3000))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(2000)] + [(names[2999], names[i]) for i in range(2100, 2990)]
    got = {x["v"]: x["comp"] for x in components.components(spark.createDataFrame(edges, "a int, b int"), 3000).collect()}
    path, star = names[:2001], names[2100:2990] + [names[2999]]
    assert got == {i: min(path) for i in path} | {i: min(star) for i in star}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 300), (300, 250), (None, 5), (260, 250)] + [(500, i) for i in range(501, 540)]
    got = {r["v"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in (200, 250, 260, 300)} | {i: 500 for i in range(500, 540)}


def test_quality(spark, hard, none):
    d = f"{DATA}/sf0.01"
    out = Q.op8_quality(spark, d).toPandas().set_index("doc_id")
    label = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id").quality
    held = out[out.held_out].join(label, how="inner")
    assert (held.predicted == held.quality).mean() > 0.95 and out.score.between(0, 1).all() and ((out.score >= 0.3) == out.predicted).all()
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        model = quality.train(hard, rows)
        assert quality.score_quality(hard, model).where("quality_score BETWEEN 0 AND 1").count() == 10
        assert quality.keep_quality(none, model).count() == 0 and quality.keep_quality(hard, model).columns == hard.columns


def test_discriminant_equals_plain_densities():
    """Scores against the plain inverse and determinant of the shrunk covariances."""
    r = np.random.RandomState(2)
    x = np.concatenate([r.standard_normal((90, 5)) @ r.standard_normal((5, 5)), r.standard_normal((60, 5)) * 2 + 0.7])
    y = np.array([0.0] * 90 + [1.0] * 60)
    model = quality.fit(x, y, 0.5, 0.2)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    cov = [np.cov(z[y == c], rowvar=False) for c in (0, 1)]
    pooled = (90 * cov[0] + 60 * cov[1]) / 150
    pooled = 0.8 * pooled + 0.2 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(5)
    dens = []
    for c in (0, 1):
        m, s = z[y == c].mean(axis=0), 0.5 * cov[c] + 0.5 * pooled
        dens.append(np.log((y == c).mean()) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(s), z - m))
    assert np.allclose(model.difference(x), dens[1] - dens[0])


def test_quality_trains_alike_on_repeated_ids(spark, docs, texts):
    """Ids with several texts and labels: one row an id, the same model whatever the order of rows."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()
    ids = [r["doc_id"] for r in labels]
    twice = [(i, texts[i]) for i in ids] + [(i, texts[j]) for i, j in zip(ids, ids[1:])] * 3
    marks = [(r["doc_id"], r["quality"]) for r in labels] + [(ids[0], 1 - labels[0]["quality"])]
    models = []
    for k in (1, -1):
        df = spark.createDataFrame(twice[::k], "doc_id bigint, text string").repartition(5 + k)
        models.append(quality.train(df, spark.createDataFrame(marks[::k], "doc_id bigint, quality int")))
    x = np.array([quality.statistics(t) for t in texts.values()])
    assert (models[0].score(x) == models[1].score(x)).all()
    own = {i: min(quality.statistics(t) for j, t in twice if j == i) for i in ids}
    known = {i: min(q for j, q in marks if j == i) for i in ids}
    assert np.allclose(quality.fit(np.array([own[i] for i in sorted(ids)]), np.array([known[i] for i in sorted(ids)], float)).score(x), models[0].score(x))


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, docs, texts, hard, none):
    keys = np.random.RandomState(1).randint(0, 2**63, 3000, np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert shards.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    out = shards.assign(docs, 8).toPandas()
    assert all(s == len(texts[i].encode()) + 1 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True))
    assert ((out.shard == out.grown_shard) | (out.grown_shard == 8)).all()
    for df in (out, shards.assign(hard, 3).toPandas()):
        for _, g in df.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    assert shards.assign(hard, 3).where("doc_id = 2 AND size = 1 AND text_crc32 = 0").count() == 1
    assert shards.assign(none, 3).count() == 0 and shards.add_shard(hard, 3).columns == hard.columns


def test_mix(spark, docs, hard, none):
    out = mixing.plan(docs).toPandas()
    out["source"] = out.doc_id.map({r["doc_id"]: r["source"] for r in docs.collect()})
    per = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "max"))
    assert ((per.target - per.taken).abs() <= per["size"] / 2).all() and (out.taken <= 3 * out["size"]).all()
    assert abs(per.target.sum() - out["size"].sum()) < 1e-3
    rows = mixing.plan(hard)
    assert rows.count() == 10 and sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, mixing.plan(hard).collect()), key=str)
    mixed = mixing.mixed(hard)
    assert mixed.columns == hard.columns and mixed.where("text IS NULL").count() == 2
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in mixed._jdf.queryExecution().toString()


def test_target_levels(spark):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 9)], "source string, source_size bigint"), (1, 2, 3), 3).collect()}
    assert got["b"] == 3.0 and got["c"] == 30.0 and got[None] == 27.0 and got["a"] == 60.0


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = ["quality", "near copies", "benchmark", "mix", "shards"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    seen = [docs.toPandas()]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SMALL)
        seen.append(docs.toPandas())
    start, good, one, clean, mixed, final = seen
    assert all(list(x.columns) == list(start.columns) for x in seen[:5])
    _, classes = brute_links({i: texts[i] for i in good.doc_id})
    assert set(one.doc_id) == {i for i, c in classes.items() if i == c}
    bad = {r["doc_id"] for r in Q.op2_decontaminate(spark, SMALL).collect()}
    assert set(clean.doc_id) == set(one.doc_id) - bad
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.doc_id.value_counts().max() <= 3
    assert len(final) == len(mixed) and final.shard.between(0, 7).all()
    run = corpus_pipeline.run(spark, SMALL).toPandas()
    assert sorted(zip(run.doc_id, run.shard, strict=True)) == sorted(zip(final.doc_id, final.shard, strict=True))


def test_stages_on_hard_and_empty_rows(spark, hard, none):
    """Each stage by itself: what it keeps of nulls, empty and very long texts, repeats and clashing columns."""
    key = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], len(r["text"] or ""), r["text"] is None) for r in df.collect())
    start = key(hard)
    got = {name: f(spark, hard, SMALL) for name, f in corpus_pipeline.STAGES}
    assert all(df.columns == hard.columns for df in got.values())
    kept = key(got["quality"])
    # Without labelled rows of both classes all are scored alike.
    assert kept in ([], start)
    assert key(got["near copies"]) == sorted(set(start) - {x for x in start if x[0] == 5})
    assert key(got["benchmark"]) == start and key(got["shards"]) == start
    mixed = key(got["mix"])
    assert set(mixed) <= set(start) and {x for x in start if x[1] == 0} <= set(mixed) and max(collections.Counter(mixed).values()) <= 6
    assert got["shards"].where("shard BETWEEN 0 AND 7").count() == len(start)
    assert got["mix"].where("digest != 'd' OR comp != 9 OR kind != 'x'").count() == 0
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, none, SMALL)
        assert out.count() == 0 and out.columns == none.columns
