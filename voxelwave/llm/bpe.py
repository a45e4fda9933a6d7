"""Operator 1: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words of a batch go into a trie; the sorted word list is that trie in depth-first order, the common prefix of
neighbours being the path they share. While walking it, each path byte keeps one *state*: the last token of the encoding of
the prefix that ends there. The state of a longer prefix follows from the states on its own path: token ``t`` ends the
encoding of prefix ``p`` exactly if ``p`` ends with ``t`` and the last token of what precedes ``t`` may stand before ``t``
(merging the two would not happen before each of them is complete). So the encoding of a shared prefix is computed once,
and a word's ids are read off by following last tokens back.

Cases: a null text counts as empty (no ids, empty decoded text). Special tokens written out in a text become their id, as in
the tokenizer library's default. Equal rows give equal results; ids of any type, null ones too, are kept; extra input columns
are ignored, whatever they are called. Texts of any length are encoded whole. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxelwave.llm.rows import pick
from voxelwave.runtime import ship

#: Unicode White_Space, as the tokenizer's pattern reads it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUST_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A text is first cut into units (an optional space and non-space characters, or white space); the word pattern never
#: matches across units, so units can be looked up whole.
_UNIT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Units and words that the young half of a worker's memory holds.
MEMO_UNITS, MEMO_WORDS = 300_000, 400_000
#: Longer ones are encoded but not remembered.
MEMO_CHARS = 64
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    """Tables of one vocabulary, and the traversal."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}  # pair -> merge rank
        self.made: dict[tuple[int, int], int] = {}  # pair -> token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            key = (self.ids[a], self.ids[b])
            token = self.ids[a + b]
            self.merged.setdefault(key, rank)
            self.made.setdefault(key, token)
            self.parts.setdefault(token, (*key, rank))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        for content, token in self.special.items():
            self.bytes.setdefault(token, content.encode())
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        reachable = {v for k, v in self.ids.items() if len(k) == 1} | set(self.parts)
        self.usable = {k: v for k, v in self.ids.items() if v in reachable and self.merge(k) == [v]}
        self.tails = self._tails()
        self.shorter = self._shorter()
        self.length = {t: len(k) for k, t in self.usable.items()}
        self._fits: dict[int, bool] = {}

    def _tails(self) -> dict[bytes, tuple[int, ...]]:
        """For the last three bytes of a prefix: the lengths, longest first, of tokens of three bytes or more that could end there."""
        out: dict[bytes, set[int]] = {}
        for k in self.usable:
            if len(k) > 2:
                out.setdefault(k[-3:], set()).add(len(k))
        return {k: tuple(sorted(v, reverse=True)) for k, v in out.items()}

    def _shorter(self) -> dict[int, int]:
        """The longest usable token that is a proper ending of a token."""
        return {t: next(self.usable[k[i:]] for i in range(1, len(k)) if k[i:] in self.usable) for k, t in self.usable.items() if len(k) > 1}

    def merge(self, word: bytes) -> list[int]:
        """Plain rank-ordered merging; used for table building and pair tests only."""
        out = [self.ids[bytes((b,))] for b in word]
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: (self.merged.get((out[i], out[i + 1]), 1 << 60), i))
            token = self.made.get((out[best], out[best + 1]))
            if token is None:
                break
            out[best : best + 2] = [token]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding: both alone, joined, encode to themselves. Remembered."""
        if len(self._fits) > 1 << 20:
            self._fits.clear()
        known = self._fits[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the later of the two last merges step by step; a merge over the border that is due earlier forbids the pair."""
        leaf = -1
        limit = 1 << 60
        parts = self.parts
        while True:
            due = self.merged.get((left, right))
            if due is not None and due < limit:
                return False
            l_rank = parts[left][2] if left in parts else leaf
            r_rank = parts[right][2] if right in parts else leaf
            if l_rank == leaf and r_rank == leaf:
                return True
            # Undo the later one. Equal pairs merge from the left: a border merge of the right side's rank comes before it.
            if l_rank > r_rank:
                limit, left = l_rank, parts[left][1]
            else:
                limit, right = r_rank + 1, parts[right][0]

    def cut(self, unit: str) -> list[bytes]:
        """The words of a unit. Code points that this Python's Unicode tables lack are classed by the library's own tables."""
        if not unit.isascii() and any(unicodedata.category(c) == "Cn" for c in unit):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [unit[a:b].encode() for _, (a, b) in self.library.pre_tokenize_str(unit)]
        return [w.encode() for w in _WORD.findall(unit)]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, by one depth-first walk of their trie."""
        out: dict[bytes, list[int]] = {}
        before = b""
        last: list[int] = []  # state by depth: last token of the prefix of that many bytes (depth 1 first)
        size: list[int] = []
        find, tails, shorter, length, known, fits = self.usable.get, self.tails.get, self.shorter, self.length, self._fits, self.fits
        for word in sorted(words):
            shared = 0
            if before[:3] == word[:3]:
                for a, b in zip(before, word):
                    if a != b:
                        break
                    shared += 1
            del last[shared:], size[shared:]
            for depth in range(shared + 1, len(word) + 1):
                # the longest token that ends here, then ever shorter ones until one fits what stands before it
                token = None
                if depth > 2:
                    for n in tails(word[depth - 3 : depth], ()):
                        if n <= depth:
                            token = find(word[depth - n : depth])
                            if token is not None:
                                break
                if token is None:
                    token = find(word[depth - 2 : depth]) if depth > 1 else None
                    if token is None:
                        token = find(word[depth - 1 : depth])
                n = length[token]
                while n < depth:
                    left = last[depth - n - 1]
                    ok = known.get(left << 32 | token)
                    if ok if ok is not None else fits(left, token):
                        break
                    token = shorter[token]
                    n = length[token]
                last.append(token)
                size.append(n)
            ids, at = [], len(word)
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            ids.reverse()
            out[word] = ids
            before = word
        return out


@lru_cache(maxsize=2)
def load(path: str) -> TrieBpe:
    return TrieBpe(path)


class Memo:
    """A dictionary of bounded size that keeps what is used: entries live in a young half and, once it is full, an old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def pick(self, keys: set) -> tuple[dict, list]:
        """Known values, and the keys that are unknown."""
        young, old, found, unknown = self.young, self.old, {}, []
        in_young, in_old = young.get, old.get
        for k in keys:
            value = in_young(k)
            if value is None:
                value = in_old(k)
                if value is None:
                    unknown.append(k)
                    continue
                young[k] = value
            found[k] = value
        return found, unknown

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


def segments(bpe: TrieBpe, text: str) -> Iterator[tuple[int | None, str]]:
    """Runs of ordinary text, and special tokens with their ids."""
    if bpe.split_special is None or not any(s in text for s in bpe.special):
        yield None, text
        return
    for part in bpe.split_special.split(text):
        if part:
            yield bpe.special.get(part), part


def text_units(bpe: TrieBpe, text: str) -> list[str | int]:
    """Units of a text; a special token stands as its id."""
    out: list[str | int] = []
    for special, part in segments(bpe, text):
        if special is None:
            out += _UNIT.findall(part)
        else:
            out.append(special)
    return out


class Encoder:
    """Per-worker encoder. Words are remembered with what ``make`` gives for their ids, units with the joined values."""

    def __init__(self, path: str, make, join, units: int = MEMO_UNITS, words: int = MEMO_WORDS):
        self.bpe, self.make, self.join = load(path), make, join
        self.units, self.words = Memo(units), Memo(words)
        self.special = {i: make([i]) for i in self.bpe.special.values()}

    def _learn(self, new: list[str]) -> dict[str, object]:
        """Values of unknown units: their unknown words go into one trie."""
        cut = {}
        for u in new:
            body = u[1:] if u[0] == " " else u
            if body.isalpha():  # one word
                cut[u] = (u.encode(),)
            elif body and body[-1] in _MARKS and body[:-1].isalpha():  # a word and a mark
                cut[u] = (u[:-1].encode(), body[-1].encode())
            else:
                cut[u] = self.bpe.cut(u)
        known, unknown = self.words.pick({w for ws in cut.values() for w in ws})
        make, join = self.make, self.join
        made = {w: make(ids) for w, ids in self.bpe.encode_words(unknown).items()}
        known.update(made)
        self.words.young.update((w, v) for w, v in made.items() if len(w) <= MEMO_CHARS)
        self.words.turn()
        return {u: known[ws[0]] if len(ws) == 1 else join([known[w] for w in ws]) for u, ws in cut.items()}

    def batch(self, texts: list[str | None], limit: int = 4 << 20) -> Iterator[list]:
        """For each text, the list of made values of its units; texts are taken in blocks of about ``limit`` characters."""
        marked = tuple(self.bpe.special)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= limit):
                size += len(texts[to] or "")
                to += 1
            units = [(text_units(self.bpe, t) if any(m in t for m in marked) else _UNIT.findall(t)) if t else [] for t in texts[at:to]]
            here, unknown = self.units.pick(set().union(*units).difference(self.special))
            here.update(self.special)
            new = self._learn(unknown)
            here.update(new)
            self.units.young.update((u, v) for u, v in new.items() if len(u) <= MEMO_CHARS)
            self.units.turn()
            get = here.__getitem__
            for u in units:
                yield list(map(get, u))
            at = to


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without searches for reference cycles: the remembered values are very many small tuples, none of which can be in one."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _joined(values: list[tuple[str, bytes, int]]) -> tuple[str, bytes, int]:
    ids, raw, n = zip(*values)
    return ",".join(ids), b"".join(raw), sum(n)


@lru_cache(maxsize=4)
def _digest_encoder(path: str) -> Encoder:
    """Decimal ids, the bytes they decode to, and their number."""
    table = load(path).bytes
    names = {i: str(i) for i in table}
    return Encoder(path, lambda ids: (",".join([names[i] for i in ids]), b"".join([table[i] for i in ids]), len(ids)), _joined, MEMO_UNITS // 2)


@lru_cache(maxsize=4)
def _array_encoder(path: str) -> Encoder:
    return Encoder(path, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)


def encode_to_bytes(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    for parts in _array_encoder(path).batch(texts):
        yield b"".join(parts)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The compiled merge library on the same vocabulary: its ids are its ranks, so ids must follow the order of merges."""
    import tiktoken

    bpe = load(path)
    order = [t for t, _ in sorted(bpe.parts.items(), key=lambda p: p[1][2])]
    if order != sorted(order):
        raise ValueError("the vocabulary's ids do not follow its merges")
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{_RUST_WHITE}]+(?![^{_RUST_WHITE}])|[{_RUST_WHITE}]+".replace(f"[^{WHITE}", f"[^{_RUST_WHITE}")
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={k: v for k, v in bpe.ids.items() if v in bpe.parts or len(k) == 1}, special_tokens={})


def library_ids(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """As :func:`encode_to_bytes`, by a compiled library; texts it may treat otherwise go through the trie.

    Those hold special tokens, or code points that are unassigned in this Python's tables.
    """
    bpe, fast = load(path), _ranked(path)
    marked = tuple(bpe.special)
    for text in texts:
        if not text:
            yield b""
        elif any(m in text for m in marked) or (not text.isascii() and _rare(text)):
            yield next(encode_to_bytes(path, [text]))
        else:
            yield fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


_PLAIN = re.compile("[\\x00-\\u02af\\u2010-\\u2027]+")


def _rare(text: str) -> bool:
    """Whether a text has unassigned code points (the usual Latin letters and marks are passed over at once)."""
    return any(unicodedata.category(c) == "Cn" for c in set(_PLAIN.sub("", text)))


def encode(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>): the general encoding operator. Narrow: no shuffle, bounded memory."""
    ship(df.sparkSession)

    def run(batches):
        import numpy as np

        for b in batches:
            rows, lens, got = b.column(0), [], []
            for raw in encode_to_bytes(vocab, b.column(1).to_pylist()):
                got.append(np.frombuffer(raw, "<u4").astype(np.int32))
                lens.append(len(got[-1]))
            values = np.concatenate(got) if got else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, id_col, text_col).toDF("id", "text").mapInArrow(run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, vocab: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text: ids back to text; bytes that are no UTF-8 become replacement characters, null ids an empty text."""
    ship(df.sparkSession)

    def run(batches):
        table = load(vocab).bytes
        for b in batches:
            texts = [b"".join(table[i] for i in ids or ()).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, id_col, ids_col).toDF("id", "ids").mapInArrow(run, f"id {kind}, text string")


def round_trip(df: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each whole text, decode the ids again, digest both.

    Decoding works on the ids' byte strings, remembered by unit; the joined bytes are decoded as UTF-8 at the end.
    """
    ship(df.sparkSession)

    def run(batches):
        coder = _digest_encoder(vocab)
        for b in batches:
            n, ids, text = [], [], []
            with no_cycles():
                for parts in coder.batch(b.column(1).to_pylist()):
                    listed, raw, count = _joined(parts) if parts else ("", b"", 0)
                    n.append(count)
                    ids.append(hashlib.sha256(listed.encode()).hexdigest())
                    text.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(df, "doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
