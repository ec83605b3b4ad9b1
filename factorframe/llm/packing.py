"""Bounded-space online packing of token sequences (operator 5).

Each task keeps ``windows`` open windows of ``length`` tokens.  A document goes to the window it fits best; where none
has room, the head of the document fills the fullest window if at least ``least`` tokens fit there, that window is
emitted, and the rest goes on; a document longer than a window is cut at full windows first.  What is open when a task
ends is merged in a last small pass over windows (not documents), 50,000 of them a task.

Tokens: the ids of a public byte-level BPE vocabulary (the same ids from its two published files), then ``end``.  The
text is encoded unit by unit, a unit being what follows a single space, with a bounded cache; texts with runs of white
space, where units are not independent, are encoded whole.  The string of a special token in a text is that token, as the
vocabulary's own tokenizer reads it.

Defined results: null and empty texts are the end token alone; repeated rows are packed separately; null ids are kept;
very long texts are cut, never shortened; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm.common import stored

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean, fill long")
#: Units kept in a task's cache; beyond it new units are encoded without being kept.
CACHE = 300_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def specials() -> dict[str, int]:
    """Special tokens of the vocabulary, by their strings."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str, special: dict[str, int]):
    """text -> little-endian 32-bit ids as bytes."""
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    pack = lambda ids: np.array(ids, dtype="<u4").tobytes()
    runs = re.compile(r"\s\s")
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
    cache: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        out, at = [], 0
        for m in marks.finditer(text):
            out += [ordinary(text[at:m.start()]), pack([special[m.group()]])]
            at = m.end()
        return b"".join([*out, ordinary(text[at:])])

    def ordinary(text: str) -> bytes:
        if not text:
            return b""
        if runs.search(text):
            return pack(plain(text))
        first, *units = text.split(" ")
        out = [pack(plain(first))]
        for u in units:
            got = cache.get(u)
            if got is None:
                got = pack(plain(" " + u))
                if len(cache) < CACHE:
                    cache[u] = got
            out.append(got)
        return b"".join(out)

    return encode


class Packer:
    """Best fit into a fixed number of open windows.  ``put`` yields closed windows, ``rest`` the open ones."""

    def __init__(self, length: int, windows: int, least: int):
        self.length, self.windows, self.least = length, windows, least
        self.open: list[list] = []  # [fill, items]

    def put(self, size: int, item, cut: bool = True):
        start = 0
        while start < size:
            left = size - start
            best = None
            for w in self.open:
                if w[0] + left <= self.length and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.windows and left <= self.length:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[1].append((item, start, left, best[0]))
                best[0] += left
                start = size
                if best[0] == self.length:
                    self.open = [w for w in self.open if w is not best]
                    yield best
            elif left > self.length:
                yield [self.length, [(item, start, self.length, 0)]]
                start += self.length
            else:  # none fits: emit the fullest
                full = max(self.open, key=lambda w: w[0])
                gap = self.length - full[0]
                if cut and gap >= self.least:
                    full[1].append((item, start, gap, full[0]))
                    full[0] += gap
                    start += gap
                self.open = [w for w in self.open if w is not full]
                yield full

    def rest(self):
        yield from self.open


def pack(docs: DataFrame, length: int = 2048, windows: int = 32, least: int = 16, end: int = 1, path: str | None = None,
         special: dict[str, int] | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary()
    special = specials() if special is None else special

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        encode, packer = encoder(path, special), Packer(length, windows, least)
        number = TaskContext.get().partitionId() << 36
        last = np.array([end], dtype="<u4").tobytes()
        columns = [x.split()[0] for x in _PIECES.split(", ")]

        def told(window, is_open):
            nonlocal number
            for (doc_id, ids), start, size, offset in window[1]:
                yield (doc_id, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), len(ids) // 4, number, offset, is_open, window[0])
            number += 1

        def frame(rows):
            x = pd.DataFrame(rows, columns=columns)
            x["doc_id"] = x["doc_id"].astype("Int64")
            return x

        rows: list[tuple] = []
        for f in frames:
            for doc_id, text in zip(f["doc_id"].tolist(), f["text"]):
                ids = encode(text or "") + last
                for w in packer.put(len(ids) // 4, (None if doc_id is None or doc_id != doc_id else int(doc_id), ids)):
                    rows += told(w, False)
                if len(rows) > 20_000:
                    yield frame(rows)
                    rows = []
        for w in packer.rest():
            rows += told(w, True)
        if rows:
            yield frame(rows)

    def merge(frames):
        import pandas as pd
        from pyspark import TaskContext

        packer, number, out = Packer(length, windows * 32, least), (1 << 62) + (TaskContext.get().partitionId() << 36), []

        def told(window):
            nonlocal number
            out.extend((key, number, offset) for key, _, _, offset in window[1])
            number += 1

        for f in frames:
            for key, fill in zip(f["window"], f["fill"]):
                for w in packer.put(int(fill), int(key), cut=False):
                    told(w)
        for w in packer.rest():
            told(w)
        yield pd.DataFrame(out, columns=["window", "to", "shift"])

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text"))
    pieces = stored(texts.mapInPandas(run, _PIECES))
    left = pieces.where("open").select("window", "fill").distinct()
    tasks = max(1, math.ceil(left.count() / 50_000))
    moved = stored(left.repartition(tasks).mapInPandas(merge, "window long, to long, shift long"))
    done = pieces.where("not open").withColumn("sequence_id", F.col("window"))
    late = pieces.where("open").join(moved, "window").withColumn("sequence_id", F.col("to")).withColumn("offset", F.col("offset") + F.col("shift"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return done.select(*columns).unionByName(late.select(*columns))
