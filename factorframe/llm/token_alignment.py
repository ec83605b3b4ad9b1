"""Cross-tokenizer alignment by an associative fragment monoid (operator 12).

Two tokenizers cut the same bytes (a space and the text).  Where tokens of both end at one offset, a group ends; tokens
whose byte ranges overlap are linked.  Both tokenizers begin a new token at a single space between two other characters,
whatever stands around it (a byte-level BPE splits there first; the piece vocabulary is checked to have no piece that
goes on over a space), so such spaces are safe cuts: what lies between two of them is tokenised and aligned by itself.

A byte range of a text becomes a fragment: an open prefix up to its first safe cut, closed groups, an open suffix from
its last one.  Fragments compose associatively: suffix and prefix join to text that is closed now, counts add,
groups append, links add as multisets; a fragment without a cut is open text only, the empty one is neutral.  Long
documents are cut into byte ranges of ``chunk`` bytes, dealt to tasks, and reduced as a tree, ``fan`` fragments a
step; short ones are a single fragment of the task that reads them.

Counts of linked id pairs over the corpus: a task writes its documents in blocks, each with its own dictionary of pairs
and the number of its documents that hold them.  Pairs are added up over blocks, joined back to the dictionaries, and
meet their block's documents again.  What moves is a dictionary a block and about a third of a byte per link, never a
row a link; nothing is broadcast or sent to the driver, and no pair, however frequent, is more rows than there are blocks.

Memory: a task holds one block (``BLOCK_BYTES`` of text), a bounded cache of words and its pairs; a document's group
list (about three times its text) has to fit a row.

Defined results: null and empty texts, and texts whose tokens do not give their bytes back (U+2581 in the text), have
zeros and an empty digest; strings of special tokens are plain text; repeated rows count as documents of their own; null
ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm.common import stored

#: Byte range of a fragment; fragments composed by a task.
CHUNK, FAN = 65_536, 8
#: Text of a block, words kept by a task, pairs kept by a task (checked between blocks).
BLOCK_BYTES, CACHE, PAIRS = 16_000_000, 200_000, 2_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"^\s|\s\s|\s\Z")
_FRAGMENT = ("doc long, doc_id string, part long, cut boolean, prefix binary, suffix binary, groups binary, sizes string, "
             "pairs binary, times binary")
_BLOCKS = ("block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, "
           "pair long, index int, n_docs long")
_ONE, _BAD = 40, 1 << 120  # three counts in one integer of 40 bits each, and a mark for bytes that differ


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Tokenises and aligns what lies between safe cuts.  A result is (groups, links, sizes): text, pair numbers as
    32-bit integers, and counts of A tokens, B tokens and groups."""

    def __init__(self, path_a: str, path_b: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = {b: a for a, b in ranks.items()}
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this vocabulary go on over spaces: there is no safe cut")
        self.encode_b = model.encode
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, tuple] = {}
        self.number: dict[int, int] = {}
        self.codes: list[int] = []

    def numbers(self, codes: list[int]) -> list[int]:
        out = []
        for code in codes:
            n = self.number.get(code)
            if n is None:
                n = self.number[code] = len(self.codes)
                self.codes.append(code)
            out.append(n)
        return out

    def word(self, word: str) -> tuple:
        """A space and ``word``."""
        raw = b" " + word.encode()
        a, b = self.encode_a(" " + word), self.encode_b(word)
        of_a, of_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            return "", b"", _BAD
        groups, codes = [], []
        i = j = first_a = first_b = 0
        end_a, end_b = len(of_a[0]), len(of_b[0])
        while True:
            codes.append(a[i] << 32 | b[j])
            if end_a < end_b:
                i += 1
                end_a += len(of_a[i])
            elif end_b < end_a:
                j += 1
                end_b += len(of_b[j])
            else:
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
                if i == len(a):
                    break
                first_a, first_b = i, j
                end_a, end_b = end_a + len(of_a[i]), end_b + len(of_b[j])
        sizes = (len(a) << _ONE | len(b)) << _ONE | len(groups)
        return ";".join(groups), np.array(self.numbers(codes), dtype=np.int32).tobytes(), sizes

    def closed(self, text: str) -> tuple:
        """A space and ``text``, which begins and ends at safe cuts or at the ends of its document."""
        words = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    got = self.words.get(words[k]) or self.word(words[k])
                    if len(self.words) < CACHE and len(words[k]) < 64:
                        self.words[words[k]] = got
                    found[k] = got
        groups, links, sizes = zip(*found)
        return ";".join(groups), b"".join(links), sum(sizes)

    def counted(self, links: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Pair codes and how often each is linked."""
        number, times = np.unique(np.frombuffer(links, dtype=np.int32), return_counts=True)
        return np.array([self.codes[i] for i in number], dtype=np.int64), times


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(path_a: str, path_b: str) -> Aligner:
    """The aligner of this task."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


# ---- fragments ----------------------------------------------------------------------------------------------------


def _summary(aligner: Aligner, text: str) -> tuple:
    groups, links, sizes = aligner.closed(text)
    return groups, sizes, *aligner.counted(links)


def fragment(aligner: Aligner, data: bytes) -> tuple:
    """(cut, prefix, suffix, closed) of a byte range; ``closed``: groups, sizes, pair codes, times.  The range may cut
    characters: their bytes stay in the open ends."""
    head = 0
    while head < min(3, len(data)) and 0x80 <= data[head] < 0xC0:
        head += 1
    text = data[head:].decode("utf-8", "ignore")  # what it leaves out is an incomplete character at the end
    tail = data[head + len(text.encode()):]
    first = _CUT.search(text)
    if first is None:
        return False, data, b"", None
    start, end = first.start(), text.rfind(" ", 0, len(text) - 1)
    while not _CUT.match(text, end):
        end = text.rfind(" ", 0, end)
    closed = _summary(aligner, text[start + 1:end]) if end > start else None
    return True, data[:head] + text[:start].encode(), text[end:].encode() + tail, closed


def _added(closed: list) -> tuple | None:
    closed = [x for x in closed if x is not None]
    if not closed:
        return None
    codes, back = np.unique(np.concatenate([x[2] for x in closed]), return_inverse=True)
    times = np.bincount(back, weights=np.concatenate([x[3] for x in closed]), minlength=len(codes)).astype(np.int64)
    return ";".join(x[0] for x in closed), sum(x[1] for x in closed), codes, times


def composed(aligner: Aligner, fragments: list[tuple]) -> tuple:
    """The fragment of neighbouring byte ranges."""
    cut, prefix, suffix, parts = False, [], [], []
    for has, head, tail, closed in fragments:
        if not has:
            (suffix if cut else prefix).append(head)
        elif not cut:
            prefix.append(head)
            cut, suffix, parts = True, [tail], [closed]
        else:  # the suffix begins with the space of its cut
            parts += [_summary(aligner, b"".join([*suffix, head])[1:].decode()), closed]
            suffix = [tail]
    return cut, b"".join(prefix), b"".join(suffix), _added(parts)


def finished(aligner: Aligner, whole: tuple) -> tuple:
    """groups, sizes, pair codes, times of a document from its only fragment."""
    cut, prefix, suffix, closed = whole
    ends = [_summary(aligner, prefix.decode())]
    return _added([*ends, closed, _summary(aligner, suffix[1:].decode())] if cut else ends)


# ---- tasks --------------------------------------------------------------------------------------------------------


class _Blocks:
    """Documents of a task in blocks, each with the dictionary of its pairs."""

    def __init__(self, aligner: Aligner, first: int):
        from pyspark import TaskContext

        self.aligner, self.block, self.rows, self.size = aligner, first + (TaskContext.get().partitionId() << 32), [], 0

    def add(self, doc_id, groups: str, links: bytes, sizes: int, times=None) -> None:
        if sizes >= _BAD or not sizes:
            self.rows.append((doc_id, 0, 0, 0, 0, "", b"", b""))
            return
        number = np.frombuffer(links, dtype=np.int32)
        if times is None:
            number, times = np.unique(number, return_counts=True)
        low = (1 << _ONE) - 1
        self.rows.append((doc_id, sizes >> 2 * _ONE, sizes >> _ONE & low, sizes & low, int(times.sum()), hashlib.sha256(groups.encode()).hexdigest(), number, times))
        self.size += len(groups)

    def full(self) -> bool:
        return self.size > 3 * BLOCK_BYTES or len(self.rows) >= 100_000

    def flush(self):
        """The block as an Arrow batch: its documents, then its dictionary."""
        import pyarrow as pa

        if not self.rows:
            return
        docs = np.zeros(len(self.aligner.codes), dtype=np.int64)
        for row in self.rows:
            if row[4]:
                docs[row[6]] += 1
        used = np.flatnonzero(docs)
        place = np.zeros(len(docs), dtype=np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        at, times = [], []
        for row in self.rows:
            mine = place[row[6]] if row[4] else np.zeros(0, np.int32)
            order = np.argsort(mine, kind="stable")
            at.append(zlib.compress(np.diff(mine[order], prepend=0).astype(np.int32).tobytes(), 1))
            times.append(zlib.compress(np.asarray(row[7] if row[4] else [], dtype=np.int64)[order].astype(np.int32).tobytes(), 1))
        n, m = len(self.rows), len(used)
        column = lambda k, kind: pa.concat_arrays([pa.array([r[k] for r in self.rows], kind), pa.nulls(m, kind)])
        later = lambda values, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind)])
        codes = np.array([self.aligner.codes[i] for i in used], dtype=np.int64)
        arrays = [pa.array(np.full(n + m, self.block)), column(0, pa.string()), *[column(k, pa.int64()) for k in (1, 2, 3, 4)], column(5, pa.string()),
                  pa.concat_arrays([pa.array(at, pa.binary()), pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.array(times, pa.binary()), pa.nulls(m, pa.binary())]),
                  later(codes, pa.int64()), later(np.arange(m, dtype=np.int32), pa.int32()), later(docs[used], pa.int64())]
        out = pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _BLOCKS.split(", ")])
        for start in range(0, n + m, 20_000):
            yield out.slice(start, 20_000)
        self.block, self.rows, self.size = self.block + 1, [], 0
        if len(self.aligner.codes) > PAIRS:
            self.aligner.forget()


def _row(key, doc_id, part, made: tuple) -> tuple:
    cut, prefix, suffix, closed = made
    groups, sizes, codes, times = closed or ("", 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    return (key, doc_id, part, cut, prefix, suffix, zlib.compress(groups.encode(), 1) if closed else None, str(sizes),
            codes.astype(np.int64).tobytes(), times.astype(np.int64).tobytes())


def _made(row) -> tuple:
    closed = None
    if row.groups is not None:
        closed = (zlib.decompress(bytes(row.groups)).decode(), int(row.sizes), np.frombuffer(bytes(row.pairs), np.int64), np.frombuffer(bytes(row.times), np.int64))
    return bool(row.cut), bytes(row.prefix), bytes(row.suffix), closed


def _frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=[x.split()[0] for x in _FRAGMENT.split(", ")])


def _long_documents(texts: DataFrame, chunk: int, fan: int, path_a: str, path_b: str) -> DataFrame:
    """Blocks of the documents longer than ``chunk`` bytes: ranges, fragments, tree."""
    size = F.octet_length("text")
    numbered = texts.where(size > chunk).withColumn("doc", F.monotonically_increasing_id())
    ranges = numbered.select("doc", "doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length(text) - 1) div {chunk}"))).alias("part"))
    ranges = ranges.select("doc", "doc_id", "part", F.substring(F.col("text").cast("binary"), (F.col("part") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))
    ranges = stored(ranges.repartition("doc", "part"))

    def cut(frames):
        aligner = loaded(path_a, path_b)
        for f in frames:
            for start in range(0, len(f), 64):
                yield _frame([_row(r.doc, r.doc_id, r.part, fragment(aligner, bytes(r.data))) for r in f[start:start + 64].itertuples()])

    def compose(frame):
        rows = list(frame.sort_values("part").itertuples())
        made = composed(loaded(path_a, path_b), [_made(r) for r in rows])
        return _frame([_row(rows[0].doc, rows[0].doc_id, rows[0].part // fan, made)])

    def finish(frames):
        aligner = loaded(path_a, path_b)
        blocks = _Blocks(aligner, 1 << 62)
        for f in frames:
            for r in f.to_pandas().itertuples():
                groups, sizes, codes, times = finished(aligner, _made(r))
                blocks.add(r.doc_id, groups, np.array(aligner.numbers(codes.tolist()), dtype=np.int32).tobytes(), sizes, times)
                if blocks.full():
                    yield from blocks.flush()
        yield from blocks.flush()

    made = ranges.mapInPandas(cut, _FRAGMENT)
    left = ranges.agg(F.max("part")).first()[0] or 0
    while left:
        made = stored(made.withColumn("step", F.expr(f"part div {fan}"))).groupBy("doc", "step").applyInPandas(
            lambda key, frame: compose(frame.drop(columns="step")), _FRAGMENT)
        left //= fan
    return made.mapInArrow(finish, _BLOCKS)


def align(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs`` (doc_id, text)."""
    path_a, path_b = vocabularies or paths()
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def read(batches):
        aligner = loaded(path_a, path_b)
        blocks = _Blocks(aligner, 0)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                blocks.add(doc_id, *(aligner.closed(text) if text else ("", b"", 0)))
                if blocks.full():
                    yield from blocks.flush()
        yield from blocks.flush()

    short = stored(texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk).mapInArrow(read, _BLOCKS))
    blocks = short.unionByName(stored(_long_documents(texts, chunk, fan, path_a, path_b)))

    held = blocks.where("pair is not null").select("block", "pair", "index", "n_docs")
    counts = stored(held.groupBy("pair").agg(F.sum("n_docs").alias("count")).withColumn("a", F.shiftright("pair", 32)))
    counts = counts.join(counts.groupBy("a").agg(F.max("count").alias("highest")), "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    scored = held.select("block", "pair", "index").join(counts, "pair").select(F.col("block").alias("of"), "index", "count", "best")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def score(left, right):
        import pandas as pd

        count, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        count[right["index"].to_numpy()] = right["count"].to_numpy()
        best[right["index"].to_numpy()] = right["best"].to_numpy()
        sums, bests = [], []
        for at, times in zip(left["at"], left["times"]):
            at = np.cumsum(np.frombuffer(zlib.decompress(bytes(at)), dtype=np.int32))
            times = np.frombuffer(zlib.decompress(bytes(times)), dtype=np.int32).astype(np.int64)
            sums.append(int((count[at] * times).sum()))
            bests.append(int((best[at] * times).sum()))
        return pd.DataFrame({**{c: left[c] for c in columns if c in left}, "n_best": bests, "count_sum": sums})[columns]

    rows = blocks.where("pair is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    out = rows.groupBy("block").cogroup(scored.groupBy("of")).applyInPandas(
        score, "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
