"""URL rules and template matching against plain Python; odd tables for all operators that take documents."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from verisift.llm import decontam, langid, lm_scoring, piece_codec, quality, substring_dedup, url_filter
from verisift.llm.queries import tokenizer_path

# --- URL rules ------------------------------------------------------------------------------------------------

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def judged(url):
    """Host, path and the rule that decides, by definition."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = regex.split("[/?#]", rest, maxsplit=1)[0]
    path = regex.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["example.com", "a.example.com", "Example.COM", "xexample.com", "com", "example.net", "b.c.example.net", "d.org", "e.fr", "org", "", "u@com", "example.com:80"]
    urls = [rng.choice(("http", "ftp", "")) + "://" + rng.choice(hosts) + rng.choice(("", "/", "/en", "/en/", "/en/7", "/en/77?x", "/de/8", "/de/", "/es/#/en/", "?/en/", "#a://b/en/")) for _ in range(400)] + [None, "", "no url", "http:/com/en/", "://com/en/", "a://b://com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p", 0.5) for i, u in enumerate(urls)], "page_id int, url string, host string, rule string, score double")
    model = url_filter.fit(url_filter.label_by_rules(pages))
    for r in url_filter.judge(pages, model, ["page_id"]).collect():
        host, path, rule, verdict = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict), urls[r["page_id"]]


# --- template windows -----------------------------------------------------------------------------------------

UNITS = decontam.UNITS.split("|")


def words_of(text):
    """Kinds, values and bare words of a text: placeholders for names, units and numbers."""
    text = regex.sub(r"([0-9])(?=\p{L})", r"\1 ", text or "")
    kinds, values = [], []
    for m in regex.finditer(r"[\p{L}\p{N}]+", text):
        w, before = m[0], text[: m.start()]
        name = regex.fullmatch(r"\p{Lu}\p{Ll}+\p{L}*", w) and regex.search(r"[\p{L}\p{N},;:] $", before)
        unit = w.lower() in UNITS and regex.search(r"[0-9] $", before)
        kinds.append("<name>" if name else "<unit>" if unit else regex.sub("[0-9]+", "<num>", w.lower()))
        values.append(("^" if name else "") + w.lower())
    return kinds, values


def leaks(docs, items, window=8):
    out = {}
    made = {i: words_of(t) for i, t in items}
    for doc, text in docs:
        kinds, values = words_of(text)
        for item, (ik, iv) in made.items():
            size = min(window, len(ik))
            total = len(ik) - size + 1 if size else 0
            thin = [sum(k not in ("<name>", "<unit>", "<num>") for k in ik[j : j + size]) < min(4, size) for j in range(total)]
            bare = lambda v: [x.removeprefix("^") for x in v]
            shifts = {}
            for j in range(total):
                for at in range(len(kinds) - size + 1):
                    if (bare(values[at : at + size]) == bare(iv[j : j + size])) if thin[j] else (kinds[at : at + size] == ik[j : j + size]):
                        shifts.setdefault(at - j, []).append((at, j))
            for met in shifts.values():
                same = sum(bare(values[a : a + size]) == bare(iv[j : j + size]) if thin[j] else values[a : a + size] == iv[j : j + size] for a, j in met)
                plain = [(a, j) for a, j in met if not thin[j]]
                slots = {(iv[j + x], values[a + x]) for a, j in plain for x in range(size) if ik[j + x].startswith("<") or "<num>" in ik[j + x]}
                consistent = len({t for t, _ in slots}) == len(slots)
                if same >= min(2, total) or (consistent and plain and len(plain) >= min(2, total - sum(thin))):
                    out.setdefault(doc, set()).add(item)
    return {d: sorted(v) for d, v in out.items()}


def test_template_windows(spark):
    rng = random.Random(12)
    vocab = "the train leaves at noon and how far does it go when speed is".split()
    say = lambda n: " ".join(rng.choice(vocab) if rng.random() < 0.7 else rng.choice(("Anna", "Bern", "Paul", str(rng.randrange(30)), "5 km", "12 days", "7km")) for _ in range(n))
    items = [(i, say(rng.choice((3, 8, 12, 20)))) for i in range(12)] + [(20, None), (21, ""), (22, "What is 12 + 34 * 56?")]
    swap = {"Anna": "Paul", "Paul": "Anna", "5": "9", "Bern": "Rome"}
    docs = []
    for i in range(90):
        text = say(rng.choice((0, 5, 30)))
        if i % 3 == 0:
            item = items[rng.randrange(12)][1]
            text += " " + (" ".join(swap.get(w, w) for w in item.split()) if i % 2 else item) + " " + say(6)
        docs.append((i, text))
    docs += [(200, None), (201, "see: What is 12 + 34 * 56?"), (202, "What is 13 + 34 * 56?"), (203, "word " * 30_000 + items[2][1])]
    got = {r["doc_id"]: list(r["item_ids"]) for r in decontam.judge(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, size int"), spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, doc_id int")).collect()}
    assert got == leaks(docs, items)


# --- odd tables -----------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t int, score int, part int, word int, h long"
MODEL = tokenizer_path("piece_bpe_32k.model")


def odd(spark):
    """Nulls, repeated and missing ids, ties, a long text, and columns named like the operators' own."""
    text = ["Die Katze sitzt auf dem Dach und schaut in den Garten.", "The cat sits on the roof and looks into the garden.", None, "", "x " * 40_000]
    rows = [(i % 12 if i % 7 else None, text[i % 5], ("de", "en", None)[i % 3], "s", i) for i in range(40)]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["lm", "langid", "quality", "codec", "repeats", "leaks"])
def test_odd_and_empty_tables(spark, name):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "The cat sits on the roof and looks into the garden.")], "item_id long, text string")
    run = {
        "lm": lambda d: lm_scoring.score_documents(d, MODEL),
        "langid": langid.identify,
        "quality": lambda d: quality.score(d, quality.fit(d, labels)),
        "codec": lambda d: piece_codec.encode_documents(d, MODEL).select("doc_id", "n_tokens"),
        "repeats": lambda d: substring_dedup.remove_repeats(d, 5, least_parts=3),
        "leaks": lambda d: decontam.judge(d, items),
    }[name]
    docs = odd(spark)
    rows, empty = run(docs).collect(), run(docs.limit(0)).collect()
    assert empty == []
    if name == "leaks":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.filter(F.col("text").startswith("The cat")).collect()}
    else:
        assert len(rows) == 40 and sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
