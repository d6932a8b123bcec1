"""Each operator on small fixtures against a brute-force version: nulls, empty and long texts, ties, repeated rows, empty
tables, and extra columns whose names clash with the operators' own."""

import hashlib
import random
import zlib
from itertools import combinations, product
from re import _parser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import chat, decontaminate, knn, license, packing, quality, rans, simhash, token_files, tokenize, url_filter, warc
from jobloom.llm.common import fresh_dir, words

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "Some plain prose about the weather, and of the sea."), (2, None), (3, ""), (4, "   \n\t "), (5, "!!!"),
    (6, "Some plain prose about the weather, and of the sea."), (6, "Some plain prose about the weather, and of the sea."),
    (7, "Über süße Éclairs, naïve ½ 12,345.67 words — 你好 \U0001f600"), (8, LONG), (9, "a"), (None, "no id here"),
    (10, "<|endoftext|> and </s>[INST] in a text  with  blanks \n \n"), (11, "CC BY cc-by 4.0, All Rights\nReserved; GNU General Public License"),
]
CLASHING = ("score", "fp", "row", "items", "spans", "rest", "diff")


def frame(spark, rows=TEXTS):
    """documents with extra columns that have the operators' own names."""
    extra = tuple(range(len(CLASHING)))
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", *extra) for i, t in rows], schema)


def empty(spark):
    return frame(spark, [])


def word_list(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    out, cur = [], ""
    for c in low:
        if ord(c) >= 128 or c.isascii() and (c.isdigit() or "a" <= c <= "z"):
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return out + [cur] * bool(cur)


@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in words(text.encode("utf-8", "ignore"))] == word_list(text.encode("utf-8", "ignore").decode())


# --- 1 quality


def test_quality_learns_and_keeps_columns(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choices(["the", "sea", "weather", "was", "calm", "and", "clear", "today"], k=60)) + "." for _ in range(150)]
    bad = ["!! ".join(rng.choices(["BUY", "NOW", "CHEAP", "WIN", "FREE"], k=60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (1000, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i] >= 0.7) == (i < 150) for i in held)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}
    odd = quality.score(frame(spark), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    by_id = {r.doc_id: r.score for r in odd}
    assert by_id[2] == by_id[3]  # null is scored as the empty text
    assert quality.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, 1)], [(1, 1), (1, 0)]])
def test_quality_without_examples_of_both_classes(spark, labels):
    model = quality.fit(frame(spark), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len({r.score for r in quality.score(frame(spark), model).collect()}) == 1


def test_quality_held_out_accuracy(spark, small):
    rows = quality.query(spark, small.replace("0.001", "0.01")).join(spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.93


# --- 2 decontamination


def brute_overlap(text, items, width=13):
    w, hit, found = word_list(text), set(), set()
    for item, body in items:
        b = word_list(body)
        for i in range(max(1, len(b) - width + 1) if b else 0):
            window = b[i : i + width]
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (10, "SHORT, item!"), (3, None), (4, "..."),
         (None, "no item id"), (5, "x"), (2, "short item")]
HITS = [(20, "zero " + ITEMS[0][1] + " fifteen"), (21, "one two three four five six seven eight nine ten eleven twelve thirteen"), (22, "a short item, short item short"),
        (23, "x x y x"), (24, "one two three four five six seven eight nine ten eleven twelve"), (25, "No Item\nid " + "pad " * 100)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_decontaminate(spark, block_bytes):
    rows = TEXTS + HITS
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.judge(decontaminate.find_overlaps(frame(spark, rows), items, block_bytes=block_bytes)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in found)
    want = []
    for i, t in rows:
        n, hit, names = brute_overlap(t, ITEMS)
        want.append((str(i), n, hit, names, hit > 0 and 20 * hit >= n))
    assert got == sorted(want)


def test_decontaminate_keeps_clean_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, TEXTS + HITS)
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in TEXTS + HITS if not (lambda o: o[1] and 20 * o[1] >= o[0])(brute_overlap(t, ITEMS)))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.keep_clean(docs, none).count() == len(TEXTS + HITS)
    assert decontaminate.keep_clean(empty(spark), items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=25), st.lists(st.lists(st.sampled_from("ab"), max_size=9), max_size=4), st.integers(1, 5))
def test_wu_manber(doc, items, width):
    items = [(str(i), " ".join(x).encode()) for i, x in enumerate(items)]
    spans, found = decontaminate.WuManber(items, width).search([c.encode() for c in doc])
    _, hit, names = brute_overlap(" ".join(doc), [(i, t.decode()) for i, t in items], width)
    assert sum(b - a for a, b in spans) == hit and sorted(found) == names


# --- 3 SimHash


def brute_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def test_simhash(spark):
    base = [f"word{i} and more of it" for i in range(40)]
    near = [(100 + i, " ".join(base[:-1] + [f"changed{i}"])) for i in range(12)] + [(90, " ".join(base))]
    rows = TEXTS + near
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted((str(i), f, str(least.get(roots[f]))) for (i, _), f in zip(rows, prints))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least.get(k)) for k in set(roots.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0


def test_components_of_random_fingerprints(spark):
    rng = random.Random(7)
    prints = set()
    while len(prints) < 400:
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):  # chains of small steps
            prints.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = spark.createDataFrame(signed(prints), "fp long")
    found = {r.node % 2**64: r.root for r in simhash.components(simhash.links(fps)).collect()}
    groups = {}
    for f, root in brute_components(prints).items():
        groups.setdefault(root, set()).add(f)
    mine = {}
    for f in prints:
        mine.setdefault(found.get(f, f - 2**64 if f >= 2**63 else f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def signed(prints):
    return [(f - 2**64 if f >= 2**63 else f,) for f in prints]


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_links_are_all_pairs_within_two_bits(spark, bucket):
    rng = random.Random(3)
    centre, prints = rng.getrandbits(64), {0, 2**64 - 1, 1, 3, 7, 2**63}
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)}
    prints |= {centre & ~0xFF | rng.getrandbits(8) for _ in range(60)}  # 56 bits in common
    prints |= {centre >> 32 << 32 | rng.getrandbits(32) for _ in range(60)}  # a half in common, and far apart
    want = {(max(p), min(p)) for p in combinations((x for (x,) in signed(prints)), 2) if ((p[0] ^ p[1]) & 2**64 - 1).bit_count() <= 2}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed(prints), "fp long"), bucket).collect()}
    assert got == want


def test_an_entry_joins_fingerprints_that_the_distance_refuses(spark):
    far = [0xABCD << 40, 0xABCD << 40 | 0xF0F0]  # equal first halves, 8 bits apart
    fps = spark.createDataFrame(signed(far), "fp long")
    entries = simhash._entries(fps.withColumn("mask", F.lit(0).cast("long")), [0])
    assert entries.groupBy("mask", "value").count().filter("count > 1").count() == 1
    assert simhash.links(fps).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=1, max_size=2), st.integers(1, 3))
def test_halves_find_every_pair_at_every_level(f, bits, depth):
    """The rule of the lookups in plain Python: of two fingerprints within 2 bits one meets the other at each depth."""
    other = f
    for bit in bits:
        other ^= 1 << bit
    pair, masks = {f, other}, {0}
    asks = {(x, x, 2, 0) for x in pair}
    for _ in range(depth):
        more = set()
        for own, x, spare, mask in asks:
            (first, half), (second, _) = simhash._halves(mask)
            more |= {(own, x, spare, first), (own, x, spare, second)}
            if spare == 2:
                more |= {(own, x ^ 1 << b, 1, first) for b in half if x >> b & 1}
        asks, masks = more, {h for m in masks for h, _ in simhash._halves(m)}
        assert any(x & mask == y & mask for own, x, _, mask in asks for y in pair - {own})


# --- 4 URLs


def test_url_rules(spark):
    urls = ["http://a.net/x", "HTTP://A.Example.NET/en/1?q#f", "https://example.com/de/", "https://m.example.com/de", "http://x.org/fr/a", "http://badexample.com/de/x",
            None, "no scheme", "", "http://net", "http://net/", "ftp://u.org?x=/fr/", "x" * 3000]
    rows = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "v")], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block") and got[3][:3] == ("m.example.com", "/de", None)
    assert got[4] == ("x.org", "/fr/a", "org/fr/", "allow") and got[5][:3] == ("badexample.com", "/de/x", None)
    assert got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[9][:3] == ("net", "", None) and got[10] == ("net", "/", "net/", "block") and got[11][:3] == ("u.org", "", None)
    assert all(v[3] in ("allow", "block") for v in got.values()) and len(url_filter.judge(rows).collect()) == len(urls) + 1
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none).count() == 0


def test_url_model_tells_its_examples_apart(spark):
    good = [(i, f"http://w{i}.org/fr/garden/{i}") for i in range(60)]
    bad = [(100 + i, f"http://w{i}.net/casino-{i}") for i in range(60)]
    new = [(200, "http://q.com/garden/9"), (201, "http://q.com/casino-9")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert got[200] == "allow" and got[201] == "block"


def brute_scores(urls, says):
    """The mean log-likelihood difference of each URL, by a model that keeps every group of four characters."""
    counts = {c: [{}, {}, {}, {}, {}] for c in ("allow", "block")}
    split = lambda u: ["   "[i:] + u[: i + 1] if i < 3 else u[i - 3 : i + 1] for i in range(len(u))]
    for u, c in zip(urls, says):
        for g in split(u) if c else ():
            for size in range(1, 5):
                counts[c][size][g[4 - size :]] = counts[c][size].get(g[4 - size :], 0) + 1
    after = {c: [{} for _ in range(4)] for c in counts}  # of each context: how often, and kinds of followers
    for c, levels in counts.items():
        for size in range(1, 5):
            for g, n in levels[size].items():
                a, k = after[c][size - 1].get(g[:-1], (0, 0))
                after[c][size - 1][g[:-1]] = (a + n, k + 1)

    def p(c, g):
        less = p(c, g[1:]) if len(g) > 1 else 1 / 256
        a, k = after[c][len(g) - 1].get(g[:-1], (0, 0))
        return (counts[c][len(g)].get(g, 0) + k * less) / (a + k) if a + k else less

    return [sum(np.log(p("allow", g)) - np.log(p("block", g)) for g in split(u)) / len(u) if u else 0.0 for u in urls]


@pytest.mark.parametrize("hot", [1, url_filter.HOT, 10**9])
def test_url_model_keeps_every_group(spark, hot):
    rng = random.Random(5)
    tail = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60))
    urls = [f"http://w{i % 9}.{('org/fr', 'net', 'com')[i % 3]}/{tail()}" for i in range(300)] + ["", "http://w.com/\U0001f600", "http://w.com/\U0001f600"]
    says = [("allow", "block", None)[i % 3] if u and i < 300 else None for i, u in enumerate(urls)]
    assert len({u[i : i + 4] for u in urls for i in range(len(u))}) > 15_000
    rows = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(zip(urls, says))], "row long, url string, says string")
    got = {r.row: r.score for r in url_filter.score(rows, url_filter.train(rows), hot).collect()}
    want = brute_scores(urls, says)
    assert [got.get(i, 0.0) for i in range(len(urls))] == pytest.approx(want, abs=1e-9) and got[301] == got[302]
    judged = {r.page_id: r.score for r in url_filter.judge(rows.withColumnRenamed("row", "page_id")).collect()}
    assert [judged[i] for i in range(len(urls))] == pytest.approx(want, abs=1e-9)


# --- 5 licenses


def test_license(spark):
    got = {r.doc_id: r for r in license.scan(frame(spark)).collect() if r.doc_id}
    r = got[11]
    assert [(p.start, p.label) for p in r.base] == [(0, "cc-by"), (2, "cc-by"), (6, "reserved"), (10, "gpl")] and r.n_words == 13
    assert "cc-by-4.0" in {d.label for d in r.detections}
    assert got[2].n_words == got[3].n_words == 0 and not got[2].base and not got[2].detections
    assert license.scan(empty(spark)).count() == 0


def test_license_rules():
    rules = license.default_rules()
    assert len(rules.all) >= 200 and len({r.pattern.pattern for r in rules.all}) == len(rules.all)
    scan = lambda s: {x[2] for x in rules.scan(words(s.encode()))[1]}
    assert scan("SPDX-License-Identifier: Apache-2.0") == {"apache-2.0"}
    assert scan("Licensed under the Apache License, Version 2.0 (the License)") == {"apache-2.0"}
    assert scan("GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert scan("ein Haus mit Garten") == set()
    # What lies inside a stronger detection goes.
    assert scan("https://creativecommons.org/licenses/by-nc/4.0/") == {"cc-by-nc-4.0"}


def expansions(pattern):
    """Texts that a pattern matches: every alternative, optional parts left out and put in, other repeats at their least."""

    def of(items):
        return ["".join(x) for x in product(*map(one, items))]

    def one(item):
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return ["7"] if any(str(a[0]) == "CATEGORY" for a in arg) else [x for a in arg for x in one(a)]
        if op == "BRANCH":
            return [x for branch in arg[1] for x in of(branch)]
        if op == "SUBPATTERN":
            return of(arg[3])
        assert op == "MAX_REPEAT"
        times = (0, 1) if arg[:2] == (0, 1) else (arg[0],)
        return ["".join(x) for n in times for x in product(of(arg[2]), repeat=n)]

    return of(_parser.parse(pattern))


def test_license_keywords_occur_in_all_that_a_rule_matches():
    rules = license.default_rules()
    for line, rule in zip(license.RULES.strip().splitlines(), rules.all):
        for text in expansions(line.split("|", 2)[2].strip()):
            assert rule.pattern.search(f" {text} ".encode()), text
            assert rule.keywords <= set(text.encode().split()), (rule.label, text)
    labels = lambda s: {x[2] for x in rules.scan(words(s.encode()))[1]}
    assert labels("CreativeML OpenRAIL-M") == labels("an Open RAIL license") == {"openrail"}
    assert labels("released under the MIT") == {"mit"} and labels("GNU General Public License v2") == {"gpl-2.0"}
    assert labels("Creative Commons Attribution Share Alike") == {"cc-by-sa"} and labels("SPDX-License-Identifier: PSF-2.0") == {"psf-2.0"}


# --- tokens


ODD = ["", " ", "  ", "a  b", "a \nb", "a\n b", "a\n \nb", "  x", "don't 'he ll 'S", "<|endoftext|> hi <|startoftext|>", "İ ΑΣ b", "a\x00b \x01", "trail  ", "tab\t x",
       "　a b", "1234 56 7", "\U0001f600 \U0001f600‍ x", "a \x85b", "x\x1c y", "À ÉTÉ ß ÿ ×÷ ªº", "CAFÉ́ x", "Ab1 2c3,4.5!!?--", "a\rb c\td", LONG[:5000]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenize.vocabulary(name))
    own.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(ODD, add_special_tokens=False)]
    assert tokenize.Encoder(tokenize.vocabulary(name)).encode(ODD) == want
    small = tokenize.Encoder(tokenize.vocabulary(name), table=3)
    assert [small.encode([t])[0] for t in ODD] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcSst12!-éß"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_on_random_texts(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokenize.encoder(tokenize.vocabulary(name))
        want = [np.array(x.ids, "<u4").tobytes() for x in e.model.encode_batch([text], add_special_tokens=False)]
        assert e.encode([text]) == want


# --- 6 token files


@pytest.mark.parametrize("n", [0, 1, rans.LANES, rans.LANES + 1, rans.LANES * rans.EVERY + 5])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.Table(np.bincount(ids, minlength=50_257))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    size = rans.LANES * rans.EVERY
    assert (rans.decode(block, table, 1, 2) == ids[size : 2 * size]).all()
    for k in {0, 8, len(block) // 2, len(block) - 1}:
        bad = bytearray(block)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)
            raise ValueError if n == 0 else AssertionError
    with pytest.raises(ValueError):
        rans.decode(block[:-1], table)


def test_token_files(spark):
    path = tokenize.vocabulary("byte_bpe_50k.json")
    where = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(frame(spark), where, path, chunk=50)
    got = sorted(token_files.read_token_files(spark, where).collect(), key=lambda r: r.start)
    e = tokenize.encoder(path)
    want = sorted((-1 if i is None else i, e.encode([t or ""])[0] + b"\x02\0\0\0") for i, t in TEXTS)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    none = fresh_dir(spark, "test-none")
    token_files.write_token_files(empty(spark), none, path)
    assert token_files.read_token_files(spark, none).count() == 0


# --- 7 chat


@given(st.text(alphabet=st.sampled_from("<>[]/sINST␛TEX|im_startend "), max_size=30))
def test_escape_round_trip(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROLS)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b ␛[INST]"), (1, 0, "user", "a"), (1, 1, "assistant", "b ␛[INST]"), (2, 0, None, None), (3, None, "tool", ""), (3, 0, "assistant", ""),
            (None, 0, "assistant", "no id"), (4, 0, "user", LONG), (4, 1, "assistant", LONG), (5, 0, "[TEXT]", said)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    path = tokenize.vocabulary("byte_bpe_50k.json")
    parts = chat.format_turns(table, path, part=200)
    got = {r.conv_id: r for r in chat.digest(parts, path).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        heard = "".join(x for _, role, x in own if role == "assistant")
        turns = "".join(f"{role}\n{x}\n" for _, role, x in own)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(heard))
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(heard.encode()).hexdigest()
        data = [bytes(p.ids) for p in sorted(parts.collect(), key=lambda p: p.part) if p.conv_id == conv]
        written = chat.render(data, path)
        assert len(written) == r.formatted_chars and chat.parse(written) == [(role, x) for _, role, x in own]
    assert chat.digest(chat.format_turns(table.limit(0), path), path).count() == 0


# --- 8 WARC


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, None, big), (4, "http://a/4", "small"), (5, "u\r\nv", "small"), (6, "http://a/6", None),
            (None, "http://a/n", "y" * 1500), (7, "http://a/7", "é" * 600), (8, "http://a/8", LONG)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, size int, digest string")
    where = fresh_dir(spark, "test-warc")
    warc.write_archives(pages, where, archive=4096)
    got = sorted(warc.read_archives(spark, where).collect(), key=lambda r: (r.page_id or 0, r.target_uri))
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2) else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    none = fresh_dir(spark, "test-warc-none")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


@pytest.mark.parametrize("hot", [0, 4, 4096])
def test_warc_tasks_that_run_again_write_equal_files(spark, tmp_path, hot):
    rows = [(i, f"http://a/{i}", "z" * 1200 if i % 3 else f"page {i} " * 200) for i in range(60)]
    files = []
    for k, some in enumerate((rows, rows[::-1], random.Random(1).sample(rows, 60))):
        pages = spark.createDataFrame(some, "page_id long, url string, html string").coalesce(1)
        warc.write_archives(pages, f"file://{tmp_path}/{k}", archive=4096, hot=hot)
        files.append({f.name: f.read_bytes() for f in (tmp_path / str(k)).iterdir()})
        got = {(r.page_id, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/{k}").collect()}
        assert got == {(i, 59 if i % 3 and i < 59 else None) for i in range(60)}
    assert len(files[0]) > 2 and files[0] == files[1] == files[2]


def test_warc_of_an_empty_table_through_the_query(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.query(spark, str(tmp_path)).collect() == []


def test_warc_reader_refuses_damage():
    a = warc.Archive(b"a dictionary of common words " * 20)
    body = b"hello " * 50
    a.add(warc.record(1, "http://a", body, len(body), hashlib.sha1(body).hexdigest(), None))
    good = bytes(a.data)
    headers, block = warc.parsed(next(warc.records(good)))
    assert warc.payload(headers, block) == body
    for bad in (good[4:], good[:-3], good[:20]):
        with pytest.raises(ValueError):
            list(warc.records(bad))
    raw = next(warc.records(good))
    for bad in (raw.replace(b"WARC/1.1", b"WARC/9"), raw[:-1], raw.replace(b"WARC-Date", b"X-Date"), raw.replace(b"hello hello", b"hallo hello", 1), raw.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            warc.parsed(bad)


# --- 9 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_pack(lengths):
    bins, offsets, made = packing.pack(np.array(lengths, np.int64), 50)
    for b in range(made):
        own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert own and [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 50
    assert made >= -(-sum(lengths) // 50)
    # First fit decreasing never needs more than 11/9 of the least number of bins; neither may this by much.
    loads = []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, used in enumerate(loads) if used + n <= 50), None)
        if i is None:
            loads.append(n)
        else:
            loads[i] += n
    assert made <= len(loads) * 1.15 + 1


@pytest.mark.parametrize(("held", "group"), [(packing.HELD, packing.GROUP), (3, 4)])
def test_packing(spark, held, group):
    path = tokenize.vocabulary("word_bpe_49k.json")
    got = packing.pack_documents(frame(spark), path, capacity=128, held=held, group=group).collect()
    e = tokenize.encoder(path)
    want = []
    for i, t in TEXTS:
        ids = e.encode([t or ""])[0] + b"\0\0\0\0"
        want += [(str(i), p, a // 4, len(ids[a : a + 512]) // 4, zlib.crc32(ids[a : a + 512])) for p, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128
    assert packing.pack_documents(empty(spark), path).count() == 0


@pytest.mark.parametrize("group", [packing.GROUP, 20])
def test_packing_of_clustered_lengths(spark, group):
    """A partition of long documents and one of short ones go together: 113 + 15 tokens fill a sequence of 128."""
    path, n = tokenize.vocabulary("word_bpe_49k.json"), 40
    rows = [(i, " ".join(["the"] * (112 if i < n else 14))) for i in range(2 * n)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = packing.pack_documents(docs, path, capacity=128, group=group).collect()
    assert sorted(r.length for r in got) == [15] * n + [113] * n and len({(r.doc_id, r.piece) for r in got}) == 2 * n
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 128 and len(used) <= n + (0 if group == packing.GROUP else 2)


# --- 10 top-k


def brute_top(rows, queries, k):
    out = []
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    q8 = lambda v: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
    good = [(i, q8(v)) for i, v in rows if i is not None and ok(v)]
    for i, v in queries:
        if ok(v):
            cut = lambda n: max(-(2**63), min(2**63 - 1, n))
            scores = sorted((-cut(sum(a * b for a, b in zip(q8(v), w))), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [1 << 20, 100])
def test_top_k(spark, query_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, rows[1][1]), (405, [0.5, 0.25]), (406, [1.0, 2.0]),
             (410, [1e30] * 8), (411, [-1e30] * 8), (412, [3e38] * 8)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, q int")
    queries = table.filter("vec_id % 10 = 0 OR vec_id IN (405, 406, 411)")
    got = knn.top_k(table, queries, k=5, shard=50, leaf=8, query_bytes=query_bytes).collect()
    want = brute_top(rows, [(i, v) for i, v in rows if i is not None and (i % 10 == 0 or i in (405, 406, 411))], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert knn.top_k(table.limit(0), table.limit(0)).count() == 0
