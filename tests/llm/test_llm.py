"""Training-data operators on small tables, against brute force; odd rows: nulls, empty and long texts, repeats, extra columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import decontam, jaccard_join, langid, lm_scoring, piece_codec, quality, substring_dedup, topk_search, url_filter, warc
from verisift.llm.common import new_path
from verisift.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, word string"
MODEL = tokenizer_path("piece_bpe_32k.model")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(("th", "er", "on", "an", "ré", "ß")) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared, rows = say(50), []
    for i in range(n):
        t = say(rng.choice((1, 3, 20, 80, 200)))
        if i % 5 == 0:
            t = say(10) + "\n" + shared + "\t" + t
        if i % 7 == 3 and rows:
            w = rows[-1][1].split(" ") if rows[-1][1] else ["x"]
            w[rng.randrange(len(w))] = "zz"
            t = " ".join(w)
        if i % 11 == 4 and rows:
            t = rows[-1][1]
        rows.append((i, t, rng.choice(("en", "de")), "s", len(t or "")))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \n", "en", "s", 2), (n + 3, "x" * 20000 + " y" * 3000, "de", "s", 1), (n + 4, "7 8 9", "en", "s", 5)]
    return [(*r, 1, "w") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


def test_piece_codec_equals_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    more = spark.createDataFrame([(1000, "héllo ▁▁ x  <s> \x01 日本\r\n🙂", None, None, None, 0, "")], SCHEMA)
    for r in piece_codec.encode_documents(docs.unionByName(more), MODEL).join(docs.unionByName(more), "doc_id").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert bytes(r["ids_le"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["decoded"] == sp.decode(ids)
        src = (r["text"] or "").encode()
        cut = lambda b: [int.from_bytes(b[i : i + 8], "little") for i in range(0, len(b), 8)]
        begin, end = cut(bytes(r["span_begin_le"])), cut(bytes(r["span_end_le"]))
        assert b"".join(src[a:b] for a, b in zip(begin, end, strict=True)) == src


def test_char_map_prefers_longest():
    import numpy as np

    assert piece_codec.CharMap(b"").longest(b"abc", 0) is None
    #: A trie over the single byte 'a' (label 97) whose value 0 is the text "b".
    units = np.zeros(256, np.uint32)
    units[0] = 1 << 10
    units[1 ^ 97] = (2 << 10) | (1 << 8) | 97
    units[(1 ^ 97) ^ 2] = 1 << 31
    blob = (1024).to_bytes(4, "little") + units.astype("<u4").tobytes() + b"b\0"
    assert piece_codec.CharMap(blob).longest(b"xa", 1) == (1, b"b")


def test_substring_dedup_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    for window in (5, 35):
        want = dict(zip([r[0] for r in rows], substring_dedup.brute_force([r[1] for r in rows], window), strict=True))
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs, window, least_parts=3).collect()}
        assert got == want
    kept = substring_dedup.remove_repeats(docs.select("doc_id", "text", "part"), carry=["part"], whole=True, least_parts=3)
    assert kept.columns == ["doc_id", "n_words", "n_removed", "kept", "part"] and kept.filter("n_removed = 0").join(docs, "doc_id").filter("NOT kept <=> text").count() == 0


def links_of(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.find_classes(docs, 4, 85, least_parts=3).collect()}
    assert got == links_of(rows, 4, 85)
    kept = {r[0] for r in jaccard_join.keep_one(docs, 4, 85).select("doc_id").collect()}
    assert kept == {d for d, (_, c) in links_of(rows, 4, 85).items() if c == d}


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n, m in ((10, 12), (2000, 2300), (2040, 2060), (9000, 10500), (300_000, 340_000)):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = np.unique(both), np.unique(np.concatenate([both[: n // 2], rng.integers(0, 1 << 63, m - n // 2, dtype=np.uint64)]))
        marks = [jaccard_join.bitmap(v) for v in (x, y)]
        apart = jaccard_join.bits_apart(*marks)
        assert 0 < apart <= len(np.setxor1d(x, y)) and apart == jaccard_join.bits_apart(*marks[::-1])


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "A train of 12 wagons leaves the old town at 9 and meets Anna near the river after 12 minutes of slow driving"), (2, None), (3, "too short")], "item_id long, text string")
    texts = {
        1: "Noise first. A train of 12 wagons leaves the old town at 9 and meets Anna near the river after 12 minutes of slow driving. More.",
        2: "A train of 15 wagons leaves the old town at 7 and meets Bella near the river after 15 minutes of slow driving",
        3: "A train of 15 wagons leaves the old town at 7 and meets Bella near the river after 16 minutes of slow driving",
        4: "Nothing of the kind is said here about any old train or town, and no one meets anyone near a river",
        5: "", 6: None, 7: "it is too short, really",
    }
    docs = spark.createDataFrame([(*x, 0) for x in texts.items()], "doc_id long, text string, item_id int")
    hits = decontam.find_hits(docs.drop("item_id"), items)
    assert {(r["doc_id"], r["item_id"]) for r in hits.filter("contaminated").collect()} == {(1, 1), (2, 1), (7, 3)}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()} == {3, 4, 5, 6}
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == 7


def test_language_id(spark):
    rng = random.Random(5)
    say = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(40))
    rows = [(i, say(("th", "er", "ing") if i % 2 else ("sch", "ung", "ä")), "en" if i % 2 else "de") for i in range(80)] + [(100, None, "en"), (101, "12 !", "de"), (102, "", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and not got[i]["rejected"] for i in range(80))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (100, 101, 102))
    assert got[3]["held_out"] == (zlib.crc32(b"3") % 4 == 2)


def test_lm_base_scores(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, MODEL, least_parts=3).collect()}
    known = collections.Counter()
    split = {d: [*(t or "").encode().lower().split(), "end"] for d, t in rows}
    for d, w in split.items():
        if zlib.crc32(str(d).encode()) % 10:
            known.update(w)
    n, v = sum(known.values()), len(known)
    for d, w in split.items():
        r = got[d]
        base = sum(math.log10((known[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert r["base_score"] == pytest.approx(base) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in known for x in w), n)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_windows_score_each_token_once():
    import numpy as np

    codec = piece_codec.PieceCodec(MODEL)
    t = lm_scoring.Texts(["a b c " * 90, "", None, "x"], codec, np.full(32001, lm_scoring.TAIL, np.int32))
    first, stop, begin = t.windows()
    seen = np.zeros(len(t.y), int)
    for a, b, c in zip(first, stop, begin, strict=True):
        seen[c : min(a + lm_scoring.WINDOW, b)] += 1
    assert (seen == 1).all()


def test_warc_round_trip(spark):
    big = "é<p>" * 60
    rows = [(3, "http://a.b/x?y", big), (1, "http://a.b/é", big), (2, None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 200), (4, "u", None), (5, "u", "tiny"), (6, "u", "tiny"), (7, "http://h/\nbad", big)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int")
    path = new_path(spark, "warc")
    got = {r["metadata"]["page_id"]: r for r in warc.captures(pages, path, payloads=True).collect()}
    for page, _, html in rows:
        raw, r = (html or "").encode(), got[page]["response"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest()) and got[page]["request"] is not None
        assert (r["record_type"], r["refers_to_page"]) == (("revisit", 1) if page in (3, 7) else ("response", None))
        assert page in (3, 7) or r["payload"] == (html or "")
    assert warc.captures(pages.limit(0), new_path(spark, "warc")).count() == 0


def test_top_k_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cell int")
    f32 = {r["vec_id"]: [math.floor(64 * x) for x in r["embedding"]] for r in df.filter("vec_id < 900").collect()}
    got = collections.defaultdict(list)
    for r in topk_search.search(df.filter("vec_id % 20 = 0"), df, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (i for i in f32 if i % 20 == 0):
        want = sorted(((-sum(a * b for a, b in zip(f32[q], v, strict=True)), i) for i, v in f32.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in want]
    assert 900 not in got and topk_search.search(df.limit(0), df.limit(0), 5).count() == 0


def test_url_filter(spark):
    urls = ["http://A.com/en/1", "http://example.com/en/77?x=1", "https://b.example.net/de/8", "http://c.net/de/9", "http://d.org/es/", "http://e.org/fr/1", None, "no url", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, path int")
    train = spark.createDataFrame([(f"http://cheap{i}.xyz/a/b/{i}?p={i}", 1) for i in range(60)] + [(f"http://good{i}.org/x", 0) for i in range(60)], "url string, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages.drop("path"), url_filter.fit(train), ["page_id"]).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["com/en/", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None, None, None, None]
    assert [got[i]["verdict"] for i in range(5)] == ["block", "allow", "block", "allow", "block"] and (got[6]["host"], got[6]["path"]) == ("", "") and got[0]["host"] == "a.com"
    scored = url_filter.judge(train.limit(60).withColumn("page_id", F.lit(1)), url_filter.fit(train), ["page_id"])
    assert scored.filter("verdict = 'block'").count() == 60


def test_quality(spark):
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice("abcdefgh") * 3 for _ in range(k))
    rows = [(i, say(40) if i % 3 else "BUY!! " * 40, "en", f"s{i % 3}", 100) for i in range(300)] + [(999, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(got[i]["keep"] == bool(i % 3) for i in range(300)) and 0 <= got[999]["score"] <= 1


def test_jaccard_odd_rows(spark):
    """Null and repeated ids are rows of their own; a chain of near copies without a common middle is one component."""
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[:i] + [f"x{j}" for j in range(i)] + words[i:]) for i in range(0, 6)]
    rows = [(5, "a b c d e f"), (5, "k l m n o p"), (1, "a b c d e f"), (7, "k l m n o p"), (None, "u v w x y z"), (9, "u v w x y z"), (None, None), (None, ""), (3, " \t"), (8, "q r"), (8, "q r")]
    rows += [(100 + i, t) for i, t in enumerate(chain)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, comp int, node string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.find_classes(docs, 4, 85, least_parts=3).collect())
    plain = links_of(list(enumerate(t for _, t in rows)), 4, 85)
    least = {}
    for i, (_, c) in plain.items():
        least[c] = min([x for x in (least.get(c), rows[i][0]) if x is not None], default=None)
    assert got == sorted((str(rows[i][0]), n, str(least[c])) for i, (n, c) in plain.items())
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard_join.keep_one(docs, 4, 85).collect())
    groups = {}
    for i, (n, c) in plain.items():
        groups.setdefault(c if n else -i - 1, []).append((rows[i][0] is None, rows[i][0] or 0, str(rows[i][1])))
    ids = [min(g)[:2] for g in groups.values()]
    assert sorted(x for x, _ in kept) == sorted(str(None if null else d) for null, d in ids)
    assert jaccard_join.find_classes(docs.limit(0), 4, 85, least_parts=3).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.find_classes(docs, 4, 40)


@pytest.mark.parametrize("percent", [50, 60, 80, 95])
def test_tiles_lose_no_link(percent):
    """Sets that link share a tile, whatever their sizes."""
    rng = np.random.default_rng(percent)
    for _ in range(600):
        n = int(rng.integers(1, 90))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = x[rng.random(len(x)) > rng.uniform(0, 0.5)]
        y = np.unique(np.concatenate([drop, rng.integers(0, 1 << 63, int(rng.integers(0, n)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
            assert len(np.intersect1d(jaccard_join.tile_keys(x, percent), jaccard_join.tile_keys(y, percent)))


def test_archives_of_many_members(spark, tmp_path):
    """Each gzip member of an archive is read, whatever its records are cut into; broken ones are errors."""
    import gzip

    one = lambda i: f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {9 + len(str(i))}\r\n\r\npage-id: {i}\r\n\r\n".encode()
    many = b"".join(gzip.compress(one(i)) for i in range(5)) + b"\0" * 7
    assert [f["warc-record-id"] for f, _ in warc.parse_records(warc.unpacked(many, 3))] == [f"<r{i}>" for i in range(5)]
    (tmp_path / "part-0.warc.gz").write_bytes(many)
    (tmp_path / "part-1.warc").write_bytes(b"".join(map(one, range(5, 700))))
    assert sorted(r["page_id"] for r in warc.read_records(spark, str(tmp_path)).collect()) == list(range(700))
    for broken in (many[:30], one(1)[:40], b"nonsense\r\n\r\n"):
        with pytest.raises((ValueError, EOFError, zlib.error)):
            list(warc.parse_records(warc.unpacked(broken)))


def test_leaks_are_judged_row_by_row(spark):
    item = "one plain question about nothing much that has more than enough words in it"
    docs = spark.createDataFrame([(None, item, 1), (None, "clean", 2), (4, item, 3), (4, "clean too", 4), (5, None, 5)], "doc_id long, text string, k int")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["k"] for r in kept.collect()) == [2, 4, 5]


def test_letters_are_letters():
    assert not langid._LETTER.search("½ ² 5 Ⅷ _") and langid._LETTER.search("5 ß")


def test_components_in_one_task_and_spread(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = [sorted(map(tuple, jaccard_join.components(links, n).select("doc", "comp").collect())) for n in (1000, 10)]
    assert got[0] == got[1] and dict(got[0])[1040] == 1000
    assert jaccard_join.components(links.limit(0)).count() == 0
