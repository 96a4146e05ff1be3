"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Text goes through in blocks. Where a space follows anything but white space, all before it is settled: the pattern always
cuts there, so its tokens go out and nothing of it is kept. Within a block the chunks between such places are told apart by
their bytes, each new one is cut by the pattern and merged, all side by side in numpy. A word longer than the window
(``Vocabulary.stream``) goes out token by token, each once it ends further back than the merge list's sufficient lookahead.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import slices
from .shared import documents
from .words import bounds, hashed, identities, spans, texts

#: Most distinct chunks that a Python worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at once.
STRETCH = 1 << 21
#: Fixed value: the public byte-level pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)


class _Alike(dict):
    """A character -> one that the pattern treats alike and that is of one class in all versions of Unicode.

    What is a letter or a number differs between versions, so the library's pattern is asked, once for each character.
    """

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__((i, i) for i in range(128))
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def __missing__(self, code: int) -> int:
        kinds = {"a": 0xE0, "1": 0xB2, "!": 0xA1}
        self[code] = next((k for x, k in kinds.items() if len(self.cut(x + chr(code))) == 1), 0xA0)
        return self[code]


_alike: list[_Alike] = []


def pieces(text: str) -> Iterator[str]:
    """A text as the pattern cuts it, by the library's classes of characters."""
    if not _alike:
        _alike.append(_Alike())
    for m in _SPLIT.finditer(text.translate(_alike[0])):
        yield text[m.start():m.end()]


#: Kinds of bytes: letter, digit, other, space, other white space, and what only the pattern itself can cut.
_LETTER, _DIGIT, _OTHER, _SPACE, _WHITE, _HARD = range(6)


def _kinds() -> np.ndarray:
    k = np.full(256, _OTHER, np.uint8)
    k[128:] = _HARD
    k[0x1C:0x20] = k[39] = _HARD  # the apostrophe may begin a contraction
    k[0x09:0x0E], k[0x20], k[48:58], k[65:91], k[97:123] = _WHITE, _SPACE, _DIGIT, _LETTER, _LETTER
    return k


_KIND = _kinds()
#: Lead bytes of two-byte letters: U+00C0 to U+027F (but for the two signs among them) and U+0400 to U+047F.
_LEAD = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
_WHITE_ASCII = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a byte-level BPE file (JSON); made once per worker by ``vocabulary``."""

    remembered = REMEMBERED

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *special.values()]) + 1
        back = {c: b for b, c in enumerate(letters)}
        self.tokens = [b""] * size
        for t, i in ids.items():
            self.tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in special.items():
            self.tokens[i] = t.encode()
        self.special = {t.encode(): i for t, i in special.items()}
        self.special_re = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.lookahead = sufficient_lookahead(left, right, made, [len(t) for t in self.tokens])
        self._table(left * size + right, made)
        self.size = size
        lengths = np.array([len(t) for t in self.tokens])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.flat_len, self.flat_at = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self._forget()

    def _table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: pair -> rank and token."""
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, 1 << 30, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(keys))
        step = 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.keys[at] < 0
            at_, who = at[free], todo[free]
            _, one = np.unique(at_, return_index=True)
            self.keys[at_[one]], self.rank[at_[one]], self.made[at_[one]] = keys[who[one]], who[one], made[who[one]]
            done = np.zeros(len(keys), bool)
            done[who[one]] = True
            todo = todo[~done[todo]]
            step += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each pair; a pair that is no merge gets a free slot, whose rank is beyond all."""
        at = self._slot(keys)
        odd = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        step = 1
        while len(odd):  # a run of filled slots may be longer than any merge's own way, so up to a free one
            at[odd] = (self._slot(keys[odd]) + step) & ((1 << self.bits) - 1)
            odd = odd[(self.keys[at[odd]] != keys[odd]) & (self.keys[at[odd]] >= 0)]
            step += 1
        return at

    def merged(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (bytes one after another), and how many each has.

        All words take their lowest-ranked merges side by side, round after round, until none has any left.
        """
        sym = self.of_byte[data]
        who = np.repeat(np.arange(len(lens)), lens)
        none = 1 << 30
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs_at(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            j = np.minimum(i + 1, len(sym) - 1)
            at = self._find(sym[i] * self.size + sym[j])
            return np.where((i < j) & (who[i] == who[j]), self.rank[at], none), self.made[at]

        if len(sym):
            rank, made = pairs_at(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            least = np.minimum.reduceat(rank, first)
            n = np.diff(np.append(first, len(sym)))
            over = least >= none
            if over.any():
                keep = np.repeat(~over, n)
                done.append((sym[~keep], who[~keep]))
                sym, who, rank, made = sym[keep], who[keep], rank[keep], made[keep]
                least, n = least[~over], n[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, n))
            near = np.concatenate([[False], np.diff(hit) == 1])
            if near.any():  # a pair of equal tokens in a run: from the left, each token at most once
                begin = np.maximum.accumulate(np.where(near, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            again = np.zeros(len(sym), bool)
            again[hit] = True
            sym, who, rank, made, again = sym[keep], who[keep], rank[keep], made[keep], again[keep]
            again[:-1] |= again[1:]
            at = np.flatnonzero(again)
            rank[at], made[at] = pairs_at(at)
        if not done:
            return np.empty(0, np.uint32), np.zeros(len(lens), np.int64)
        ids, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=len(lens))

    def stream(self, word: bytes) -> Iterator[np.ndarray]:
        """Token ids of one long word in constant memory: a token goes out once it ends ``lookahead`` bytes before what has been read."""
        window = self.window
        held, at = b"", 0
        while at < len(word) or held:
            held += word[at:at + window]
            at = min(len(word), at + window)
            ids, _ = self.merged(np.frombuffer(held, np.uint8), np.array([len(held)]))
            if at >= len(word):
                yield ids
                return
            ends = np.cumsum(self.flat_len[ids])
            n = int(np.searchsorted(ends, len(held) - self.lookahead, "right"))
            yield ids[:n]
            held = held[int(ends[n - 1]) if n else 0:]

    @property
    def window(self) -> int:
        return 4 * self.lookahead + 4096

    def _forget(self) -> None:
        """Remembered chunks: hashes in order, identities, and where in ``pool`` the ids of each are."""
        self.hash, self.low, self.high = (np.empty(0, np.uint64) for _ in range(3))
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def of_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as the pattern cuts them, one after another, and how many each has; equal words are merged once."""
        low, high = identities(data, start, size)
        order = np.lexsort((high, low))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]) if len(order) else np.empty(0, bool)
        first = order[new]
        ids, n = self.merged(slices(data, start[first], size[first]), size[first])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        ends = np.cumsum(n)
        return slices(ids, (ends - n)[which], n[which]), n[which]

    def of_chunks(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each by itself, one after another, and how many each has."""
        flat = slices(data, start, size)
        ends = np.cumsum(size)
        at = ends - size
        kind = _KIND[flat]
        lead = np.flatnonzero(_LEAD[flat])
        lead = lead[lead + 1 < len(flat)]
        lead = lead[~((flat[lead] == 0xC3) & ((flat[lead + 1] == 0x97) | (flat[lead + 1] == 0xB7)))]
        kind[lead] = kind[lead + 1] = _LETTER
        before = np.concatenate([[_OTHER], kind[:-1]])
        inner = np.ones(len(flat), bool)
        inner[at] = False
        white = (kind == _SPACE) | (kind == _WHITE)
        odd = (kind == _HARD) | (inner & ((kind == _SPACE) | (white & (before >= _SPACE) & (before <= _WHITE))))
        hard = np.diff(np.concatenate([[0], np.cumsum(odd)])[np.append(at, len(flat))]) > 0
        hard |= size > self.window
        for token in self.special:
            for i in np.flatnonzero(size == len(token)).tolist():
                hard[i] |= flat[at[i]:ends[i]].tobytes() == token
        begin = np.flatnonzero(~inner | ((kind != before) & (before != _SPACE)))
        of = np.searchsorted(at, begin, "right") - 1
        length = np.diff(np.append(begin, len(flat)))
        easy = ~hard[of]
        ids, n = self.of_words(flat, begin[easy], length[easy])
        many = np.bincount(of[easy], n, len(size)).astype(np.int64)
        if not hard.any():
            return ids, many
        own, counts, words, which = [], [], [], []
        for i in np.flatnonzero(hard).tolist():
            text = flat[at[i]:ends[i]].tobytes()
            if text in self.special:
                words.append(None)
                which.append((i, self.special[text]))
                continue
            for piece in pieces(text.decode()):
                words.append(piece.encode())
                which.append((i, None))
        short = [w if w is not None and len(w) <= self.window else b"" for w in words]
        lens = np.fromiter(map(len, short), np.int64, len(short))
        some, k = self.of_words(np.frombuffer(b"".join(short), np.uint8), np.cumsum(lens) - lens, lens) if lens.any() else (np.empty(0, np.uint32), np.zeros(len(short), np.int64))
        where = np.concatenate([[0], np.cumsum(k)])
        by_chunk: dict[int, list[np.ndarray]] = {}
        for j, (i, special) in enumerate(which):
            parts = by_chunk.setdefault(i, [])
            if special is not None:
                parts.append(np.array([special], np.uint32))
            elif short[j]:
                parts.append(some[where[j]:where[j + 1]])
            else:
                parts += self.stream(words[j])
        own = [np.concatenate(p) if p else np.empty(0, np.uint32) for p in by_chunk.values()]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        pool = np.concatenate([ids, *own])
        begin = np.cumsum(many) - many
        begin[list(by_chunk)], many[list(by_chunk)] = len(ids) + np.cumsum(counts) - counts, counts
        return slices(pool, begin, many), many

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: at texts, special tokens, and spaces that follow anything but white space."""
        a, b = int(offsets[0]), int(offsets[-1])
        at = np.flatnonzero(data[a:b] == 0x20) + a
        at = at[at > a]
        before = data[at - 1]
        ok = ~_WHITE_ASCII[before]
        wide = np.flatnonzero(before >= 0x80)  # the last byte of a character that may be white space
        if len(wide):
            x = at[wide]
            two, three = data[np.maximum(x - 2, 0)], data[np.maximum(x - 3, 0)]
            ok[wide] = ~((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
        parts = [at[ok], offsets[:-1][np.diff(offsets) > 0]]
        if self.special_re:
            for m in self.special_re.finditer(data[a:b]):
                x, y = m.start() + a, m.end() + a
                if offsets[np.searchsorted(offsets, x, "right")] >= y:
                    parts.append(np.array([x, y] if y < b else [x]))
        start = np.sort(np.concatenate(parts))
        return start[np.concatenate([[True], start[1:] != start[:-1]])] if len(start) else start

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[i]:offsets[i + 1]]``, one after another, and where each text's begin."""
        # What reads words copies all that it is given.
        data, offsets = data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]
        start = self.chunks(data, offsets)
        size = np.diff(np.append(start, offsets[-1]))
        low, high = identities(data, start, size)
        h = hashed(low, high)
        order = np.argsort(h)
        same = (h[order][1:] == h[order][:-1]) & (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
        first = order[np.concatenate([[True], ~same])] if len(order) else order
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(order) else 0
        known = np.minimum(np.searchsorted(self.hash, h[first]), max(len(self.hash) - 1, 0))
        have = (self.hash[known] == h[first]) & (self.low[known] == low[first]) & (self.high[known] == high[first]) if len(self.hash) else np.zeros(len(first), bool)
        if len(self.hash) + len(first) - have.sum() > self.remembered:
            self._forget()
            have[:] = False
        new = first[~have]
        if len(new):
            ids, n = self.of_chunks(data, start[new], size[new])
            where = np.searchsorted(self.hash, h[new])
            put = lambda old, values: np.insert(old, where, values)
            self.at, self.n = put(self.at, len(self.pool) + np.cumsum(n) - n), put(self.n, n)
            self.hash, self.low, self.high = put(self.hash, h[new]), put(self.low, low[new]), put(self.high, high[new])
            self.pool = np.concatenate([self.pool, ids])
        # What equals in hash but not in identity stands beside it: look on until it is found.
        known = np.searchsorted(self.hash, h[first])
        off = np.flatnonzero((self.low[known] != low[first]) | (self.high[known] != high[first])) if len(first) else known
        while len(off):
            known[off] += 1
            off = off[(self.low[known[off]] != low[first][off]) | (self.high[known[off]] != high[first][off])]
        n = self.n[known][which]
        ids = slices(self.pool, self.at[known][which], n)
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets, "left")]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """All texts in blocks of about ``STRETCH`` bytes: range of texts, their ids, and where each one's begin. A longer text comes in several blocks, one after another, cut where all before is settled."""
        for lo, hi in spans(offsets, STRETCH):
            a, b = int(offsets[lo]), int(offsets[hi])
            if b - a <= STRETCH:
                yield (lo, hi, *self.block(data, offsets[lo:hi + 1]))
                continue
            while a < b:
                to = min(b, a + STRETCH)
                while to < b:
                    # A settled place with the text around it; the block ends at the last one, or reads on until there is one.
                    settled = self.chunks(data, np.array([a, to]))
                    if len(settled) > 1 and not self._within_special(data, int(settled[-1]), b):
                        to = int(settled[-1])
                        break
                    to = min(b, to + STRETCH)
                yield (lo, hi, *self.block(data, np.array([a, to])))
                a = to

    def _within_special(self, data: np.ndarray, at: int, end: int) -> bool:
        """A special token has no space inside, but one may go across the end of what has been looked at."""
        return bool(self.special) and any(data[at:min(end, at + len(t))].tobytes() == t for t in self.special)

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens of some texts, and where each text's begin: what the byte-to-text decoder reads next."""
        n = self.flat_len[ids]
        return slices(self.flat, self.flat_at[ids], n), np.concatenate([[0], np.cumsum(n)])[first]


def sufficient_lookahead(left: np.ndarray, right: np.ndarray, made: np.ndarray, size: list[int]) -> int:
    """Bytes after a token's end beyond which nothing that follows can change it.

    What is appended can change a merge (u, v) at the end of what is read. Further to the left it can only act through
    merges (x, u) or (x, uv) of higher rank, whose turn comes later: a chain of rising ranks. From the last merge to the
    first, ``reach[y]`` is the longest way, in bytes, of a chain that begins with a merge whose right part is ``y``.
    """
    reach: dict[int, int] = {}
    longest = 0
    for u, v, uv in zip(left[::-1].tolist(), right[::-1].tolist(), made[::-1].tolist(), strict=True):
        far = size[u] + max(reach.get(u, 0), reach.get(uv, 0))
        reach[v] = max(reach.get(v, 0), far)
        longest = max(longest, far)
    return longest + max(size)


_made: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _made:
        _made[path] = Vocabulary(path)
    return _made[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Text:
    """One text on its way through: what has come out so far, as digests and an incremental byte-to-text decoder that keeps the bytes of a character that isn't complete."""

    def __init__(self, keep: bool):
        self.n, self.sha, self.text_sha = 0, hashlib.sha256(), hashlib.sha256()
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.ids = [] if keep else None

    def take(self, ids: np.ndarray, raw: np.ndarray) -> None:
        self.n += len(ids)
        self.sha.update(ids)
        self.text_sha.update(self.state.decode(raw.tobytes()).encode())
        if self.ids is not None:
            self.ids.append(ids.astype(np.int32))

    def end(self) -> tuple:
        self.text_sha.update(self.state.decode(b"", True).encode())
        return self.n, self.sha.hexdigest(), self.text_sha.hexdigest()


def _round_trip(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            data, off = texts(batch.column(1))
            done, rows, now, at = 0, [], _Text(with_ids), 0

            def out(done=0):
                n, sha, text_sha = zip(*(r.end() for r in rows), strict=True)
                cols = [batch.column(0).slice(done, len(rows)), pa.array(n, pa.int64()), pa.array(sha), pa.array(text_sha)]
                names = ["_key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = [x for r in rows for x in r.ids]
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))))
                return pa.record_batch(cols, names + ["ids"] * with_ids)

            for lo, hi, ids, first in v.encode(data, off):
                raw, begin = v.decoded(ids, first)
                if lo != at:  # a long text has ended
                    rows.append(now)
                    now, at = _Text(with_ids), lo
                for i in range(len(first) - 1):
                    now.take(ids[first[i]:first[i + 1]], raw[begin[i]:begin[i + 1]])
                    if len(first) > 2 or int(off[hi] - off[lo]) <= STRETCH:
                        rows.append(now)
                        now, at = _Text(with_ids), at + 1
                if rows and at == hi:
                    yield out(done)
                    done, rows = done + len(rows), []
            if at < batch.num_rows:
                rows.append(now)
            if rows:
                yield out(done)

    return run


def encode_decode(df: DataFrame, vocab: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Key, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text, encoded and decoded again.

    Ids are those of the tokenizer file ``vocab``; a special token's string in a text is that token. Null and empty
    texts have no tokens; texts of any length are taken by stretches; repeated rows and null keys are rows like others.
    Each row is done by itself: no shuffle. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").cast("binary").alias("t"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_round_trip(vocab or default_vocabulary(), with_ids), schema).withColumnRenamed("_key", key)


def op2_bpe_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
