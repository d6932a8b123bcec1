"""Alignment of two tokenizers against encoding whole texts, on prose, odd white space, control characters and noise."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jobloom.llm import alignment
from jobloom.llm.tokenize import BYTE_LEVEL, vocabulary
from tests.llm.test_queries import folder  # noqa: F401

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {chr(c): n for n, c in BYTE_LEVEL.items()}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return a, b, lambda i: bytes(shown[c] for c in a.id_to_token(i)), bytes_b


def plain_groups(models, text):
    """Groups of the whole text's ids, or None."""
    a, b, bytes_a, bytes_b = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a, parts_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return None
    ends = []
    for parts in (parts_a, parts_b):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        ends.append(out)
    groups, last = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, own) if last < e <= cut] for ids, own in zip((ids_a, ids_b), ends)))
        last = cut
    return groups


def plain(models, rows):
    found = [plain_groups(models, t) for _, t in rows]
    links = [Counter((i, j) for left, right in g for i in left for j in right) if g else Counter() for g in found]
    documents = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (i, _), n in documents.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, _), groups, own in zip(rows, found, links):
        if not groups:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        best = sum(n for pair, n in own.items() if documents[pair] == most[pair[0]])
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(own.values()), best,
                    sum(n * documents[pair] for pair, n in own.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def noise(seed):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "​", "a", "the", "é", "ß", "中文", "😀", "'s", "'ll", "1", "12", "!", "...", "\x00", "<s>", "</s>",
                "<|endoftext|>", "<0x41>", "ﬁ", "é", "Straße", "mañana", "un", "believ", "able", "--", "\r\n", "x" * 9]
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))


TEXTS = [
    None, "", " ", "  ", "\n", "word", " word", "word ", "two  blanks", "a \n b", "a\n b", "tab\t x", "the   x", "x▁y and more", "plain text after", "Ünïcödé wörds, 中文 and 😀!",
    "it's we'll they'd", "<s> [INST] <|endoftext|> </s>", "x" * 5000, "long " * 3000, "\x00 \x01 nul", "the the the the",
]


@pytest.mark.parametrize("block", [1, 2000, alignment.BLOCK])
def test_alignment(spark, models, block):
    rows = [*enumerate(TEXTS), *((100 + s, noise(s)) for s in range(120)), (3, TEXTS[8]), (None, "the text without id")]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, block int, segment string").repartition(3)
    made = alignment.align(docs, A, B, block)
    assert sorted(map(tuple, made.documents.collect()), key=str) == sorted(plain(models, rows), key=str)
    pairs = made.pairs.collect()
    assert len({(r.id_a, r.id_b) for r in pairs}) == len(pairs) and {r.id_a for r in pairs if r.best} == {r.id_a for r in pairs}
    own = made.segments.collect()
    assert len({r.segment for r in own}) == len(own)


def test_segments_keep_the_tokens(models):
    a, b, *_ = models
    own = alignment.pair(A, B)
    for text in [t for t in TEXTS if t] + [noise(s) for s in range(1000, 1600)]:
        parts = alignment.segments(pa.array([text], pa.large_string()))[0].as_py()
        assert "".join(" " + p for p in parts) == " " + text
        ids_a, ids_b = own.encode(parts)
        assert sum(ids_a, []) == a.encode(" " + text, add_special_tokens=False).ids and sum(ids_b, []) == b.encode(text)


def test_bytes_that_are_no_text(spark, models):
    docs = spark.createDataFrame([(1, bytearray(b"good text")), (2, bytearray(b"bad \xff text"))], "doc_id long, raw binary").selectExpr("doc_id", "CAST(raw AS STRING) AS text")
    got = {r.doc_id: tuple(r) for r in alignment.align(docs, A, B).documents.collect()}
    assert got[2] == (2, 0, 0, 0, 0, 0, 0, "") and got[1] == plain(models, [(1, "good text")])[0]


def test_no_documents(spark, folder):  # noqa: F811
    assert alignment.query(spark, folder()).collect() == []


def test_no_tokens(spark, folder):  # noqa: F811
    got = alignment.query(spark, folder(documents=[(1, None, "en", "s", 0, 0.0, "")])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_vocabulary_that_merges_over_blanks_is_refused(tmp_path):
    import json

    own = json.load(open(A, encoding="utf-8"))
    own["model"]["vocab"]["aĠb"] = len(own["model"]["vocab"])
    path = tmp_path / "bad.json"
    path.write_text(json.dumps(own))
    with pytest.raises(ValueError, match="reaches over a blank"):
        alignment.Pair(str(path), B)
