"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For a byte-level BPE vocabulary, the last token of the encoding of a prefix p[:i] of a pre-token is the one vocabulary
token t that ends at i and may follow the last token of p[:i - len(t)]; so count(i) = count(i - len(t)) + 1. Two tokens
may follow each other if the merges keep them apart. Counts of a text are sums over its pre-tokens, so one pass gives
the count at every prefix, and budgets are answered from the stored counts with no second encoding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayline.llm import common

#: Distinct pre-tokens a worker remembers before it starts anew.
CACHE_ENTRIES = 2_000_000
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one tokenizer file (byte-level BPE with the regular split, no normaliser, no prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        if spec["model"].get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("ignore_merges and stripping added tokens are not supported")
        chars = _byte_chars()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._vocabulary([[bytes(chars[c] for c in part) for part in (m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]])
        self._fits: dict[tuple[int, int], bool] = {}
        self.reset()
        self.classes = _char_classes()

    def _vocabulary(self, merges: list[list[bytes]]) -> None:
        """Number tokens by the time their merge has: bytes first."""
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = self.number[a], self.number[b]
            if a + b not in self.number:
                self.number[a + b] = len(self.parts)
                self.parts.append(pair)
            self.merged[pair] = max(self.number[a + b], 256)
        #: token number by bytes; -1 for bytes that only end longer tokens
        self.suffix = {t[-n:]: -1 for t in self.number for n in range(1, len(t) + 1)} | self.number

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pre-tokens
        self.slot = np.zeros(0, np.int64)  # their place in self.first
        self.first = np.zeros(1, np.int64)
        self.chars = np.zeros(0, np.uint32)  # the known pre-tokens, one after another
        self.deltas = np.zeros(0, np.int16)  # and their deltas

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges keep a and b apart when their bytes stand side by side.

        Undo the merges of both from the latest to the earliest: at each time the two tokens at the border must not have
        a merge that came before the one undone next.
        """
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            got, left, right, before = True, a, b, len(self.parts)
            while True:
                joined = self.merged.get((left, right))
                if joined is not None and joined < before:
                    got = False
                    break
                # on a tie in time the left one merges first, so the right one is undone first
                if right >= left and right >= 256:
                    before, right = right + 1, self.parts[right][0]
                elif left >= 256:
                    before, left = left, self.parts[left][1]
                else:
                    break
            self._fits[a, b] = got
        return got

    def byte_counts(self, piece: bytes) -> list[int]:
        """The token count of piece[:i] for i = 0 .. len(piece)."""
        n = len(piece)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        suffix, fits = self.suffix.get, self._fits
        for i in range(1, n + 1):
            for j in range(i - 1, -1, -1):
                t = suffix(piece[j:i])
                if t is None:
                    break
                if t < 0:
                    continue
                if j:
                    pair = last[j], t
                    ok = fits.get(pair)
                    if not (self.follows(*pair) if ok is None else ok):
                        continue
                counts[i], last[i] = counts[j] + 1, t
                break
        return counts

    def char_deltas(self, piece: str) -> list[int]:
        """Differences of the counts at successive character prefixes of one pre-token."""
        text = piece.encode("utf-8")
        counts = self.byte_counts(text)
        if len(text) != len(piece):
            counts = [counts[0], *(counts[i] for i in range(1, len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80)]
        d = [b - a for a, b in zip(counts, counts[1:], strict=False)]
        if piece in ("'re", "'ve", "'ll"):
            # a cut contraction is split before its letter: "'r" is two pre-tokens
            d = [1, 1, counts[-1] - 2]
        if max(d) > 32_767 or min(d) < -32_767:
            raise ValueError("a count jumps by more than 32,767 at one character")
        return d

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        new, sizes = [], []
        for t in texts:
            d = self.char_deltas(t)
            new += d
            sizes.append(len(d))
        slots = np.arange(len(texts)) + len(self.first) - 1
        self.first = np.concatenate([self.first, np.cumsum(sizes) + self.first[-1]])
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)])
        self.deltas = np.concatenate([self.deltas, np.array(new, np.int16)])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.slot = np.insert(self.keys, at, hashes[order]), np.insert(self.slot, at, slots[order])

    def deltas_of(self, texts: list[str]) -> list[bytes]:
        """For each text an int16 per character: the token count's change from prefix i to prefix i + 1."""
        plain = [t if not self.special_at or not self.special_at.search(t) else "" for t in texts]
        sizes = np.array([len(t) for t in plain], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = self._plain(codes, bounds, "".join(plain))
        out = [flat[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))]
        for i, t in enumerate(texts):
            if plain[i] != t:
                out[i] = self._special(t)
        return out

    def _plain(self, codes: np.ndarray, bounds: np.ndarray, text: str) -> np.ndarray:
        n = len(codes)
        if not n:
            return np.zeros(0, np.int16)
        starts = split_starts(self.classes[codes], codes, bounds)
        ends = np.append(starts[1:], n)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        place = np.arange(n + 1) if len(raw) == n else np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])
        hashes = common.span_hashes(raw, place[starts], place[ends])
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_ENTRIES:
            self.reset()
        at = np.searchsorted(self.keys, distinct)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == distinct) if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            self.learn(distinct[new], [text[starts[where[j]] : ends[where[j]]] for j in new])
            at = np.searchsorted(self.keys, distinct)
        slot, size = self.slot[at][back], ends - starts
        place = np.minimum(np.repeat(self.first[slot] - starts, size) + np.arange(n), len(self.chars) - 1)
        flat = self.deltas[place].astype(np.int64)
        # a hash only proposes: pre-tokens whose characters differ from the known one's are counted on their own
        other = np.add.reduceat(self.chars[place] != codes, starts, dtype=np.int64) + (self.first[slot + 1] - self.first[slot] != size)
        for j in np.flatnonzero(other):
            flat[starts[j] : ends[j]] = self.char_deltas(text[starts[j] : ends[j]])
        self._spaces(flat, codes, bounds, text)
        return flat.astype(np.int16)

    def _spaces(self, flat: np.ndarray, codes: np.ndarray, bounds: np.ndarray, text: str) -> None:
        """A prefix that ends with a run of two or more white-space characters has the run as one pre-token, though the whole text splits it."""
        space = self.classes[codes] == _SPACE
        edge = np.zeros(len(codes) + 1, bool)
        edge[bounds] = True
        joined = space[1:] & space[:-1] & ~edge[1:-1]  # i + 1 continues the run of i
        if not joined.any():
            return
        follows = np.append(~space[1:] & ~edge[1:-1], False)
        for e in np.flatnonzero(np.append(False, joined) & follows):
            s = e
            while s and joined[s - 1]:
                s -= 1
            run = text[s : e + 1]
            diff = sum(self.char_deltas(run)) - int(flat[s : e + 1].sum())
            flat[e] += diff
            flat[e + 1] -= diff

    def _special(self, text: str) -> bytes:
        """A text with special strings: each is one token; prefixes that cut one have its part as plain text, which only the last pre-token before it can join."""
        out, at = [], 0
        for m in self.special_at.finditer(text):
            part = text[at : m.start()]
            d = np.frombuffer(self.deltas_of([part])[0], np.int16).astype(np.int64)
            out.append(d)
            before, tail = int(d.sum()), ""
            if part:
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                tail = part[split_starts(self.classes[codes], codes, np.array([0, len(codes)]))[-1] :]
            base = before - (sum(self.char_deltas(tail)) if tail else 0)
            cuts = [base + np.frombuffer(self._no_special(tail + m[0][:k]), np.int16).sum(dtype=np.int64) for k in range(1, len(m[0]))] + [before + 1]
            out.append(np.diff([before, *cuts]))
            at = m.end()
        out.append(np.frombuffer(self.deltas_of([text[at:]])[0], np.int16).astype(np.int64))
        return np.concatenate(out).astype(np.int16).tobytes()

    def _no_special(self, text: str) -> bytes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._plain(codes, np.array([0, len(codes)]), text).tobytes()


def _char_classes() -> np.ndarray:
    import unicodedata

    t = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = _LETTER
        elif k == "N":
            t[c] = _NUMBER
        elif k == "Z":
            t[c] = _SPACE
    t[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    return t


def split_starts(cls: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the regular byte-level split begins its pre-tokens: contractions; runs of letters, of numbers and of other signs, each with one space before; white space, of which a last character before other text stands apart."""
    n = len(cls)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begin = edge[:n].copy()
    change = np.empty(n, bool)
    change[0], change[1:] = True, cls[1:] != cls[:-1]
    space = cls == _SPACE
    led = np.empty(n, bool)  # a plain space of the same text stands before
    led[0], led[1:] = False, codes[:-1] == 32
    led &= ~edge[:n]
    nxt_text = np.append(~space[1:], False) & ~edge[1:]  # the next character is of the same text and no white space
    begin |= change & ~(led & ~space)
    begin |= space & nxt_text
    quote = np.flatnonzero((codes == 39) & (change | edge[:n]) & ~led)
    if len(quote):
        pad = np.concatenate([codes, np.zeros(3, np.uint32)])
        stop = np.searchsorted(bounds, quote, "right")
        room = bounds[stop] - quote - 1
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (room >= 1)
        two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & (room >= 2)
        for hit, size in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            begin[q + 1] = False
            after = q + 1 + size
            after = after[after < n]
            begin[after[~(led[after] & ~space[after])]] = True
    return np.flatnonzero(begin)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str | None = None) -> PrefixCounter:
    """This process's counter for a file."""
    path = path or _default_path()
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_token_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_chars, n_tokens and prefix_deltas.

    prefix_deltas has one signed 16-bit number (little-endian) per character; the exact count of text[:i] is the sum of its
    first i numbers (prefix_count, longest_within). A count that jumps by more than 32,767 at one character raises ValueError. Null text counts as empty: 0 bytes, 0 tokens, no deltas. Rows are handled one by
    one, so repeated ids and rows, empty tables and further columns (which are not read) need no care; an id column that is
    named like a result column takes its place. tokenizer: path of
    a byte-level BPE .json readable by executors; None: the public byte_bpe_50k.json of each executor.
    """
    common.ship(df.sparkSession)
    kind, made = df.schema[id_col].dataType.simpleString(), ["n_bytes", "n_chars", "n_tokens", "prefix_deltas"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            for block in common.blocks(batch.column(1)):
                lo, hi = int(block.rows[0]), int(block.rows[-1]) + 1
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                deltas = c.deltas_of(texts)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(block.bounds)), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(np.frombuffer(d, np.int16).sum(dtype=np.int64)) for d in deltas], pa.int64()), pa.array(deltas, pa.binary())],
                    names=["_id", *made],
                )

    out = df.select(df[id_col], df[text_col]).mapInArrow(run, f"_id {kind}, n_bytes long, n_chars long, n_tokens long, prefix_deltas binary")
    return common.named(out, id_col, made)


def prefix_count(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(np.frombuffer(deltas, np.int16)[:n_chars].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """The most characters whose prefix has at most budget tokens (counts may fall again as merges form, so the last such prefix)."""
    counts = np.cumsum(np.concatenate([[0], np.frombuffer(deltas, np.int16).astype(np.int64)]))
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0
