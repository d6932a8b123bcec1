"""Byte-pair encoding of whole texts with the tokenizers library and a vocabulary file.

The byte-level and the word-level pre-tokenizers never join what stands on either side of a blank, so a column of texts is
cut at blanks and only its different pieces are encoded, all in Arrow. Pieces met before come from a table. New ones of
plain letters, digits and signs are cut into words as the pre-tokenizer would, and the different words go to the library's
model; pieces of other characters go to the library whole. The ids are those of encoding the texts at once.
Where blanks meet other white space the byte-level model looks at both, and the whole text goes to the library; so do all
texts of other kinds of model.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once.
BLOCK = 8 << 20
#: Bytes of a table of pieces (or of first pieces) that a worker keeps; a fuller one forgets what the last block didn't use.
TABLE = 32 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces whose words, lower case and normal form are the same for Python and for the library.
_PLAIN = rf"^[!-~\n{_LETTERS}]+$"
#: What looks beyond its blank: nothing, or white space first.
_OPEN = r"^(?:$|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = re.compile(rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+| ")
_LISTS = pa.list_(pa.uint32())

# The printable bytes that byte-level vocabularies write as themselves; the rest follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the installed public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(batches: Iterable[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in batches of about `most` bytes: small ones would be looked up one by one in a large table."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class _Table:
    """Strings and their ids, in Arrow. Strings not met before are given to find, all at once."""

    def __init__(self, find: Callable[[pa.Array], pa.ListArray]):
        self.find = find
        self.forget()

    def forget(self) -> None:
        self.keys, self.lists = pa.array([], pa.string()), pa.array([], _LISTS)

    def places(self, values: pa.Array) -> np.ndarray:
        """Where the table holds the values; self.lists has their ids there."""
        known = len(self.keys)
        coded = pa.concat_arrays([self.keys, values]).dictionary_encode()
        if len(coded.dictionary) > known:
            self.lists = pa.concat_arrays([self.lists, self.find(coded.dictionary[known:])])
            self.keys = coded.dictionary
        return coded.indices[known:].to_numpy()

    def trim(self, used: np.ndarray, most: int) -> None:
        """Keeps only the used places if the table has more than `most` bytes, and nothing if they have more, too."""
        if self.keys.nbytes + self.lists.nbytes > most:
            kept = pa.array(np.unique(used))
            self.keys, self.lists = self.keys.take(kept), self.lists.take(kept)
            if self.keys.nbytes + self.lists.nbytes > most:
                self.forget()


def _lists(found: list[list[int]]) -> pa.ListArray:
    return pa.array(found, _LISTS)


class Encoder:
    """Texts to ids. Strings of special tokens are ordinary text."""

    def __init__(self, path: str, table: int = TABLE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.table = Tokenizer.from_file(path), table
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        steps = own["pre_tokenizer"].get("pretokenizers", [own["pre_tokenizer"]])
        #: The byte-level model keeps the blank, as part of the word that follows; the word-level one drops it.
        self.keeps_blank = own["normalizer"] is None and steps[0].get("use_regex", False) and not steps[0]["add_prefix_space"]
        split = steps[0].get("pattern", {}).get("Regex", "") if steps[0].get("behavior") == "Removed" and steps[0]["invert"] else ""
        self.by_blank = self.keeps_blank or split == rf"{_ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
        self.blank = chr(BYTE_LEVEL[32])
        self.tokenize = self.model.model.tokenize
        self.pieces, self.heads = _Table(self._pieces), _Table(self._library)

    def _library(self, texts: pa.Array) -> pa.ListArray:
        return _lists([e.ids for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])

    def _words(self, words: Iterable[str]) -> pa.ListArray:
        """The ids of words, given to the model as the byte-level step writes them."""
        found = []
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles among them
        try:
            for word in words:
                if word == " ":  # where a piece starts in the word-level model
                    found.append([])
                    continue
                if word.isascii() and word.isprintable():
                    shown = self.blank + word[1:] if word[0] == " " else word
                else:
                    shown = word.encode().decode("latin-1").translate(BYTE_LEVEL)
                found.append([t.id for t in self.tokenize(shown)])
        finally:
            if collects:
                gc.enable()
        return _lists(found)

    def _pieces(self, pieces: pa.Array) -> pa.ListArray:
        """The ids of pieces that stand after a blank; none where a piece looks beyond it."""
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        if self.keeps_blank:
            plain &= ~pc.match_substring_regex(pieces, _OPEN).to_numpy(zero_copy_only=False)
        odd = pieces.filter(pa.array(~plain))
        if self.keeps_blank:
            odd = pc.if_else(pc.match_substring_regex(odd, _OPEN), "", pc.binary_join_element_wise(" ", odd, ""))
        found = [self._library(odd)]
        if plain.any():
            own = pieces.filter(pa.array(plain))
            joined = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), " ")[0].as_py()
            cut = _BYTE_WORDS.findall(joined) if self.keeps_blank else _LOWER_WORDS.findall(joined.lower())
            number = {word: i for i, word in enumerate(dict.fromkeys(cut))}
            ids = self._words(number).take(pa.array(np.fromiter(map(number.__getitem__, cut), np.int64, len(cut))))
            first = np.fromiter((word[0] == " " for word in cut), bool, len(cut))
            offsets = ids.offsets.to_numpy()
            found.append(pa.ListArray.from_arrays(pa.array(np.append(offsets[:-1][first], offsets[-1])), ids.values))
        order = np.empty(len(pieces), np.int64)
        order[~plain], order[plain] = np.arange(len(odd)), len(odd) + np.arange(len(pieces) - len(odd))
        return pa.concat_arrays(found).take(pa.array(order))

    def _block(self, texts: pa.Array, end: int | None) -> pa.ListArray:
        cut = pc.split_pattern(texts, " ")
        pieces, offsets = cut.values, cut.offsets.to_numpy()
        head = np.zeros(len(pieces), bool)
        if self.keeps_blank:
            head[offsets[:-1]] = True
        later = self.pieces.places(pieces.filter(pa.array(~head)) if self.keeps_blank else pieces)
        first = self.heads.places(pieces.filter(pa.array(head))) if self.keeps_blank else np.array([], np.int64)
        pool = [self.pieces.lists, self.heads.lists]
        places = np.empty(len(pieces), np.int64)
        places[~head], places[head] = later, first + len(self.pieces.lists)
        size = sum(map(len, pool))
        if self.keeps_blank:
            # No piece that was encoded has no ids, so these look beyond their blank.
            none = np.zeros(len(pieces), bool)
            none[~head] = (np.diff(self.pieces.lists.offsets.to_numpy()) == 0)[later]
            whole = np.flatnonzero(np.logical_or.reduceat(none, offsets[:-1])) if len(texts) else []
            if len(whole):
                pool += [self._library(texts.take(pa.array(whole))), _lists([[]])]
                for k, row in enumerate(whole.tolist()):
                    places[offsets[row] : offsets[row + 1]] = size + len(whole)
                    places[offsets[row]] = size + k
                size += len(whole) + 1
        if end is not None:
            pool.append(_lists([[end]]))
            places = np.insert(places, offsets[1:], size)
            offsets = offsets + np.arange(len(offsets))
        ids = pa.concat_arrays(pool).take(pa.array(places))
        self.pieces.trim(later, self.table)
        self.heads.trim(first, self.table)
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[offsets]), ids.values)

    def blocks(self, texts: pa.Array, end: int | None = None, most: int = BLOCK) -> Iterator[pa.ListArray]:
        """The ids of each text (null: empty) and then end if given, in order, some texts at a time.

        The offsets of a list array start at 0, and its values are the ids of its texts and no others. Bytes that are not
        UTF-8 are read as replacement characters.
        """
        texts = texts.cast(pa.large_binary())
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        group = (np.cumsum(lengths) - lengths) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else []
        for a, b in zip(edges, edges[1:]):
            part = texts[a:b]
            try:
                part = part.cast(pa.string())
            except pa.ArrowInvalid:
                part = pa.array([(t or b"").decode("utf-8", "replace") for t in part.to_pylist()], pa.string())
            part = pc.fill_null(part, "")
            if not self.by_blank:
                found = [e.ids for e in self.model.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
                yield _lists([ids + [end] * (end is not None) for ids in found])
                continue
            kept = self.pieces
            if 8 * int(lengths[a:b].sum()) < kept.keys.nbytes:  # to look through the whole table would take longer
                self.pieces = _Table(self._pieces)
            yield self._block(part, end)
            self.pieces = kept
            pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for found in self.blocks(pa.array(texts, pa.large_string())):
            data, at = found.values.to_numpy().astype("<u4").tobytes(), found.offsets.to_numpy().tolist()
            out += [data[4 * a : 4 * b] for a, b in zip(at, at[1:])]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, table: int = TABLE) -> Encoder:
    """One encoder for each worker process and vocabulary: its table serves all tasks of the worker."""
    return Encoder(path, table)
