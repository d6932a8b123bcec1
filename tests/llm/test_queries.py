"""The registered queries over small tables against versions of them written plainly, and over empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobloom.llm import chat, decontaminate, knn, license, packing, quality, simhash, token_files, url_filter, warc
from jobloom.llm.license_rules import RULES
from jobloom.llm.tokenize import vocabulary
from tests.llm.test_operators import TEXTS, brute_components, brute_fingerprint, brute_overlap, expansions

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars int, score double, fp string",
    "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn int, role string, text string", "embeddings": "vec_id long, embedding array<float>",
}


@pytest.fixture
def folder(spark, tmp_path):
    def write(**rows):
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(rows.get(name, []), schema).repartition(2).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write


def documents(texts):
    return [(i, t, "en", "s", 0, 7.0, "x") for i, t in texts]


def library(name):
    own = Tokenizer.from_file(vocabulary(name))
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("module", [quality, decontaminate, simhash, url_filter, license, token_files, warc, packing, knn])
def test_empty_tables(spark, folder, module):
    assert module.query(spark, folder()).collect() == []


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- 1


def test_quality_scores(spark, folder):
    rng = random.Random(5)
    good = [" ".join(rng.choices("the sea and weather was calm on clear days of spring".split(), k=rng.randrange(5, 90))) for _ in range(120)]
    bad = [rng.choice(["!!", "$$ "]).join(rng.choices("BUY NOW CHEAP WIN FREE xx".split(), k=rng.randrange(5, 90))) for _ in range(120)]
    texts = [*enumerate(good + bad), (500, None), (501, ""), (502, "a" * 40_000), (3, good[3]), (None, "no id")]
    where = folder(documents=documents(texts), labels=[(i, int(i < 120), 0) for i in range(240)] + [(7, None, 0), (999, 1, 1)])
    model = quality.fit(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))

    def size(data, text):
        pack = lambda part: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False).compress(part))
        return max(1, sum(pack(text[i : i + 512]) - pack(b"") for i in range(0, len(text), 512)))

    def plain(text):
        diff = per_byte = 0.0
        if text:
            g, b = size(model.good, text.encode()), size(model.bad, text.encode())
            diff, per_byte = (b - g) / (b + g), math.log(g / len(text.encode()))
        z = np.dot(model.weights, [1, 10 * diff, 10 * abs(diff), per_byte, per_byte**2])
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = quality.query(spark, where).collect()
    assert len(got) == len(texts)
    want = {}
    for i, t in texts:
        want.setdefault(i, plain(t))
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and all(r.predicted == (r.doc_id < 120) for r in held)


def test_quality_learns_nothing_from_the_held_out_fold(spark, folder):
    texts = [(i, f"words of text {i} and {i * 7}") for i in range(80)]
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = [(i, i % 2, 0) for i, _ in texts]
    frames = [spark.createDataFrame(documents(texts), SCHEMAS["documents"])]
    models = [quality.fit(frames[0], spark.createDataFrame([(i, 1 - q if flip and i in held else q, 0) for i, q, _ in labels], SCHEMAS["labels"])) for flip in (False, True)]
    assert models[0] == models[1]


# --- 2, 3


def test_decontaminate_rows(spark, folder):
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, "two words"), (11, "Two, WORDS!"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(13)))]
    texts = [*TEXTS, (50, "x " * 10 + items[0][1]), (51, "w0 w1 w2"), (52, "some two words " + "pad " * 40), (53, "two words " * 3)]
    got = decontaminate.query(spark, folder(documents=documents(texts), benchmark=items)).collect()
    want = []
    for i, t in texts:
        n, hit, found = brute_overlap(t, items)
        want.append((str(i), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


def test_simhash_rows(spark, folder):
    base = [f"word{i} and more of it" for i in range(40)]
    texts = [*TEXTS, *((100 + i, " ".join(base[:-1] + [f"changed{i}"])) for i in range(12)), (99, " ".join(base)), (98, " ".join(base))]
    prints = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(prints)
    least = {}
    for (i, _), f in zip(texts, prints):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    got = simhash.query(spark, folder(documents=documents(texts))).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(i), f"{f:016x}", str(least.get(roots[f]))) for (i, _), f in zip(texts, prints))


# --- 5

LINES = [[p.strip() for p in line.split("|", 2)] for line in RULES.strip().splitlines()]


def plain_scan(text):
    """The eight columns but the id, every rule tried everywhere."""
    w = plain_words(text)
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    line, found = f" {' '.join(w)} ", []
    for order, (head, _, pattern) in enumerate(LINES):
        priority, confidence, label = head.split()
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            found.append((int(priority), m.start(), m.end(), order, label, float(confidence)))
    kept = []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[3], d[1])):
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    base = {label for _, label in places}
    score = max([d[5] for d in kept] + [0.6] * bool(places) + [0.0])
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), score


def test_license_rows(spark, folder):
    rng = random.Random(9)
    said = [t for _, _, pattern in LINES for t in expansions(pattern)]
    texts = [*TEXTS, *((1000 + i, t) for i, t in enumerate(rng.sample(said, 300)))]
    fill = ["CC BY", "General Public License", "all rights, reserved", "cc-by all rights reserved", "und", "gpl", "\n", "Mit"]
    texts += [(2000 + i, " ".join(rng.choice([rng.choice(said), rng.choice(fill)]) for _ in range(rng.randrange(1, 7)))) for i in range(300)]
    got = license.query(spark, folder(documents=documents(texts))).collect()
    mine = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels, r.score) for r in got)
    want = sorted((str(i), n, k, str(a), str(b), base, labels, score) for i, (n, k, a, b, base, labels, score) in ((i, plain_scan(t)) for i, t in texts))
    assert mine == want


# --- 6, 7, 9, 10


def test_token_file_rows(spark, folder):
    encode, texts = library("byte_bpe_50k.json"), [t for t in TEXTS if t[0] is not None]
    got = sorted(token_files.query(spark, folder(documents=documents(texts))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in texts)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(encode(t or "")) + 1, crc([*encode(t or ""), 2])) for i, t in texts)


def test_chat_rows(spark, folder):
    rows = [(1, 1, "assistant", "b ␛[INST]"), (1, 0, "user", "a"), (2, 0, "user", None), (3, 0, "assistant", ""), (4, 0, "user", TEXTS[9][1]), (4, 1, "assistant", "<s>" * 50)]
    rows.append((5, 0, "tool", "<|im_start|>"))
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: r for r in chat.query(spark, folder(conversations=rows)).collect()}
    every = rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {c for c, *_ in every}
    for conv, r in got.items():
        own = [(role, text or "") for c, _, role, text in sorted(every, key=lambda x: x[:2]) if c == conv]
        heard = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(heard))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(heard.encode()).hexdigest()
        written = "<s>" + "".join(f"[INST]{role}[/INST][TEXT]{chat.escape(t)}[/TEXT]" for role, t in own) + "</s>"
        assert r.formatted_chars == len(written) and chat.parse(written) == own


def test_chat_of_an_empty_table(spark, folder):
    assert [r.conv_id for r in chat.query(spark, folder()).collect()] == [-7]


def test_packing_rows(spark, folder):
    encode, texts = library("word_bpe_49k.json"), [t for t in TEXTS if t[0] is not None]
    got = packing.query(spark, folder(documents=documents(texts))).collect()
    want, total = [], 0
    for i, t in texts:
        ids = [*encode(t or ""), 0]
        total += len(ids)
        want += [(i, p, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_top_k_rows(spark, folder):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(220)] + [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [1.0, 2.0]), (50, rng.normal(size=6).astype(np.float32).tolist())]
    quantized = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None for x in v)]
    want = []
    for q, v in quantized:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in quantized if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = knn.query(spark, folder(embeddings=rows)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    none = spark.createDataFrame([(i, v) for i, v in rows if i % 50], SCHEMAS["embeddings"])
    assert knn.top_k(none, none.filter("vec_id % 50 = 0")).collect() == []  # rows, and no queries
    assert knn.top_k(none.limit(0), none).collect() == []  # queries, and no rows
    other = none.withColumn("embedding", F.slice("embedding", 1, 3))
    assert knn.top_k(none, other.filter("vec_id = 1")).collect() == []  # queries of a length that no row has
