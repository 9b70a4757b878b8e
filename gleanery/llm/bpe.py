"""BPE encoding and decoding by tree concatenation, exactly as the tokenizer's library does it.

A text is a sequence of units with places in its UTF-8 bytes. Where white space ends
each pre-token, what lies between ASCII white space is encoded on its own and
is one unit; the ids of equal units are computed once and kept in a bounded cache. A stretch
without white space that is longer than UNSPLIT is encoded with places, and each token is a
unit. Where a tokenizer's tokens may hold white space, which is tried when it is loaded, all text
is such a stretch.

A text longer than LEAF bytes is cut into halves, again and again, at the character in the
middle, wherever that falls. The leaves are encoded, their stretches of over UNSPLIT bytes in one
parallel call, and neighbours are joined upwards. A join encodes a window around the cut and widens it until
AGREE units in a row near its start equal units of the left side, and near its end units of the
right side, in place and ids. There the window takes over, so each two neighbouring units of
the result are neighbours in some encoding that the library made. For units between white space
that settles it; for tokens, a sequence is the encoding of its text if each two neighbours are
the encoding of theirs. A window that has grown to both whole sides is simply their encoding.

Cases. Null text: like an empty one, no ids, and an empty decoded text. Strings of special
tokens become their ids, as the library does by default. Repeated rows: each is returned. Empty
table: empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import WHITESPACE, prefixed, small_batches

LEAF, UNSPLIT, WINDOW, AGREE = 16384, 512, 64, 2
GROUP = 64  # words that are encoded as one text, with a space between
CACHE_UNITS = 400_000
BATCH_BYTES = 1 << 20
SPACE = np.isin(np.arange(256), list(WHITESPACE))
OUTPUTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "ids": T.ArrayType(T.LongType()), "decoded": T.StringType()}
ARROW = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int64()), "decoded": pa.string()}

class Units(NamedTuple):
    """Places in the bytes of a text, ascending, and the ids of each unit as unsigned 32-bit numbers."""

    starts: np.ndarray
    stops: np.ndarray
    ids: list[bytes]

    def cut(self, a: int, b: int) -> "Units":
        return Units(self.starts[a:b], self.stops[a:b], self.ids[a:b])


def joined(parts: list[Units]) -> Units:
    return Units(np.concatenate([p.starts for p in parts]), np.concatenate([p.stops for p in parts]), [i for p in parts for i in p.ids])


def batch(encode, texts: list[str], parallel: bool) -> list:
    """One call of the library for all texts, which reads from the environment whether it may use threads.

    Long stretches are worth threads; with single words these cost more than the encoding.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel else "false"
    return encode(texts, add_special_tokens=False) if texts else []


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def oldest(cache: dict) -> None:
    """Leave the older half of a full cache: frequent units come early."""
    kept = list(islice(cache.items(), CACHE_UNITS // 2))
    cache.clear()
    cache.update(kept)


class Plain(dict):
    """The ids of a unit to its tokens' names with a space between, filled as units come."""

    def __init__(self, names: dict[int, bytes]):
        self.names = names

    def __missing__(self, ids: bytes) -> bytes:
        if len(self) >= CACHE_UNITS:
            oldest(self)
        out = self[ids] = b" ".join(map(self.names.__getitem__, array("I", ids)))
        return out


class Codec:
    """A tokenizer with truncation and padding off, and the cache of units."""

    def __init__(self, model: str, leaf: int = LEAF, unsplit: int = UNSPLIT):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.unsplit, self.cache = leaf, unsplit, {}
        self.worded = self.ends_at_space(model)
        self.plain: Plain | None = None
        if self.tokenizer.decoder is None:  # then tokens are put together with a space between
            self.plain = Plain({i: t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()})

    def ends_at_space(self, model: str) -> bool:
        """Whether white space ends every pre-token and leaves no token of its own."""
        if any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in json.loads(model)["added_tokens"]):
            return False
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        words = ("a", "The", "it's", "12", "-", "\u00e9\u0301", "ab.c")
        return all(ids(f"{v}{space}{w}") == ids(v) + ids(w) for v in words for w in words for space in (" ", "\n", "\t ", "\r\n", "  ", "\x0b", "\x0c"))

    def learn(self, words: set[bytes]) -> None:
        """Encode in one call, GROUP words at a time, what the cache lacks."""
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_UNITS:
            oldest(self.cache)
            new = words.difference(self.cache)
        new = list(new)
        groups = [new[k : k + GROUP] for k in range(0, len(new), GROUP)]
        texts = [b" ".join(g).decode() for g in groups]
        for group, text, e in zip(groups, texts, batch(self.tokenizer.encode_batch, texts, parallel=False)):
            points, ids = np.frombuffer(text.encode("utf-32-le"), np.uint32), packed(e.ids)
            starts = np.concatenate([[0], np.flatnonzero(points == 32) + 1, [len(points)]])
            ends = (4 * np.searchsorted([a for a, _ in e.offsets], starts)).tolist()  # the tokens before each word
            self.cache.update(zip(group, map(ids.__getitem__, map(slice, ends, ends[1:]))))

    @staticmethod
    def placed(text: str, base: int, encoding) -> Units:
        """A unit for each token of a stretch of text that begins at the byte base."""
        at = np.array(encoding.offsets, np.int64).reshape(-1, 2)  # in characters
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[at]
        return Units(at[:, 0] + base, at[:, 1] + base, [packed([i]) for i in encoding.ids])

    def units(self, text: bytes, spans: list[tuple[int, int]]) -> list[Units]:
        """The units of text[a:b] for each span; all stretches that are not cached share one parallel call."""
        out, long, words_of = [], [], []
        for a, b in spans:
            if self.worded:
                gap = np.concatenate([[True], SPACE[np.frombuffer(text, np.uint8, b - a, a)], [True]])
                edges = np.flatnonzero(gap[1:] != gap[:-1]) + a
                starts, stops, words = edges[::2], edges[1::2], text[a:b].split()
            else:
                starts, stops, words = np.array([a]), np.array([b]), [text[a:b]]
            most = self.unsplit if self.worded else -1
            over = np.flatnonzero(stops - starts > most).tolist()
            words_of.append((starts, stops, words, over))
            long += [words[k].decode() for k in over]
        self.learn({w for _, _, words, _ in words_of for w in words if len(w) <= self.unsplit} if self.worded else set())
        found = iter(zip(long, batch(self.tokenizer.encode_batch, long, parallel=True)))
        for starts, stops, words, over in words_of:
            parts, last = [], 0
            for k in [*over, len(words)]:
                parts.append(Units(starts[last:k], stops[last:k], list(map(self.cache.__getitem__, words[last:k]))))
                if k < len(words):
                    parts.append(self.placed(*(lambda t, e: (t, int(starts[k]), e))(*next(found))))
                last = k + 1
            out.append(joined(parts))
        return out

    def tree(self, text: bytes) -> Units:
        """The units of a text: leaves first, then joins from the bottom up."""
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            halves = []
            for a, b in zip(cuts, cuts[1:]):
                m = (a + b) // 2
                while m > a and text[m] & 0xC0 == 0x80:  # not inside a character
                    m -= 1
                halves += [a, m] if m > a and b - a > self.leaf else [a]
            if len(halves) + 1 == len(cuts):
                break
            cuts = [*halves, len(text)]
        level = self.units(text, list(zip(cuts, cuts[1:])))
        while len(level) > 1:
            odd = len(level) % 2
            both = [self.join(text, *cuts[k : k + 3], *level[k : k + 2]) for k in range(0, len(level) - 1, 2)]
            level = both + level[len(level) - odd :]
            cuts = cuts[:-1:2] + [len(text)]
        return level[0]

    def join(self, text: bytes, a: int, m: int, b: int, left: Units, right: Units) -> Units:
        """The units of text[a:b] from those of text[a:m] and text[m:b]."""
        reach = WINDOW
        while True:
            low, high = max(a, m - reach), min(b, m + reach)
            while low > a and text[low] & 0xC0 == 0x80:
                low -= 1
            while high < b and text[high] & 0xC0 == 0x80:
                high += 1
            window = self.units(text, [(low, high)])[0]
            if low == a and high == b:
                return window
            head = (0, 0) if low == a else self.common(left, window, low, high, first=True)
            tail = (len(right.ids), len(window.ids)) if high == b else self.common(right, window, low, high, first=False)
            if head and tail and head[1] <= tail[1]:
                return joined([left.cut(0, head[0]), window.cut(head[1], tail[1]), right.cut(tail[0], len(right.ids))])
            reach *= 2

    @staticmethod
    def common(side: Units, window: Units, low: int, high: int, first: bool) -> tuple[int, int] | None:
        """Places in side and window inside a run of AGREE units that both have.

        The run is the first, or the last, that touches neither end of the window. The places
        are after its first unit for the left side and before its last one for the right side.
        """
        order = range(len(window.ids) - AGREE + 1)
        for k in order if first else reversed(order):
            if window.starts[k] <= low or window.stops[k + AGREE - 1] >= high:
                continue
            i = int(np.searchsorted(side.starts, window.starts[k]))
            own, other = side.cut(i, i + AGREE), window.cut(k, k + AGREE)
            if own.ids == other.ids and np.array_equal(own.starts, other.starts) and np.array_equal(own.stops, other.stops):
                return (i + 1, k + 1) if first else (i + AGREE - 1, k + AGREE - 1)
        return None

    def encode(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """The ids of each text's units; short texts share one call."""
        if not self.worded:
            short = [t for t in texts if len(t) <= self.leaf]
            found = iter(batch(self.tokenizer.encode_batch_fast, [t.decode() for t in short], parallel=False))
            for t in texts:
                yield [packed(next(found).ids)] if len(t) <= self.leaf else self.tree(t).ids
            return
        split = [t.split() if len(t) <= self.leaf else None for t in texts]
        plain = [s is not None and max(map(len, s), default=0) <= self.unsplit for s in split]
        self.learn(set().union(*(s for s, p in zip(split, plain) if p)))
        whole = [list(map(self.cache.__getitem__, s)) if p else None for s, p in zip(split, plain)]
        for t, w in zip(texts, whole):
            yield self.tree(t).ids if w is None else w

    def decode(self, units: list[bytes]) -> bytes:
        """The text of all units' ids."""
        if self.plain is not None:
            return b" ".join(filter(None, map(self.plain.__getitem__, units)))
        return self.tokenizer.decode(array("I", b"".join(units)).tolist(), skip_special_tokens=False).encode()


def parts(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts with about so many bytes, so that few words are held at a time."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def lists(ids: list[bytes]) -> pa.Array:
    """Ids of several texts as an Arrow column."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.uint32).astype(np.int64)))


def encoded(docs: DataFrame, path: str, outputs: tuple[str, ...] = tuple(OUTPUTS), text: str = "text", leaf: int = LEAF) -> tuple[DataFrame, dict[str, str]]:
    """docs without the text but with the wanted ones of OUTPUTS, and the names these got.

    path: the tokenizer's file on the driver, which sends it to the executors.
    """
    rest = [c for c in docs.columns if c != text]
    names = prefixed(docs, *outputs)
    schema = T.StructType([*docs.select(*rest).schema.fields, *(T.StructField(names[o], OUTPUTS[o]) for o in outputs)])
    with open(path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, leaf)
        hexed = lambda data: hashlib.sha256(data).hexdigest()
        made = {
            "n_tokens": lambda ids, _: len(ids) // 4, "ids_sha256": lambda ids, _: hexed(ids), "decoded_sha256": lambda _, plain: hexed(plain),
            "decoded": lambda _, plain: plain.decode(),
        }
        decodes = {"decoded", "decoded_sha256"} & set(outputs)
        for b in batches:
            texts = [x.as_py() or b"" for x in pc.cast(b.column(len(rest)), pa.binary())]
            done = 0
            for part in parts(texts):
                rows = [(b"".join(units), codec.decode(units) if decodes else b"") for units in codec.encode(part)]
                cols = [lists([r[0] for r in rows]) if o == "ids" else pa.array([made[o](*r) for r in rows], ARROW[o]) for o in outputs]
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(part)) for c in b.columns[: len(rest)]), *cols], schema.names)
                done += len(part)

    return small_batches(docs).select(*rest, text).mapInArrow(run, schema), names
