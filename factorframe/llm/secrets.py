"""Secret scan with a random forest against false positives (operator 10).

Candidates are runs of 16 or more characters of keys (letters, digits, ``+ / _ -``) with a digit, or with capitals after
small letters, and, whatever their characters, the whole quoted or unspaced values of 6 or more characters after a
credential's name with ``=`` or ``:`` and the passwords in URLs.  A forest judges them by length, character classes, transitions, coverage by the corpus's own letter
trigrams (the dictionary, at most 64 ** 3 entries, counted over all documents), path, and the words around.  It is
trained by Spark on labelled findings: those that the caller gives, or those whose context settles the matter (an
assignment to a credential's name, a provider's fixed format; against that card numbers, identifiers named as such, and
words of the corpus).  Training takes at most ``train_rows`` findings of each label, chosen by hash; the model, the
dictionary and the scan cover all documents.

Defined results: null and empty texts have no findings; repeated rows are scanned each; without findings of both labels
the labels decide alone (score 1 or 0, unlabelled 0); null doc_id is kept; other columns pass through ``redacted``
untouched (n_chars follows the new text); an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm.common import shared, stored
from factorframe.llm.language_id import GRAMS, learn
from factorframe.llm.symbols import BITS

FEATURES = ("length", "digits", "capitals", "small", "others", "hex", "turns", "entropy", "log_letters", "coverage", "assigned", "quoted",
            "credential", "harmless", "path", "checksum", "family", "words_between")
#: A trigram belongs to the dictionary if it is at least this share of all.
COMMON = 2e-5
# Names of credentials, harmless names, and formats that providers publish.
CREDENTIAL = re.compile(r"(?i)(token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|credential|bearer|authorization)")
HARMLESS = re.compile(r"(?i)\b(example|sample|test|dummy|placeholder|sha1|sha256|md5|commit|checksum|digest|uuid|guid|isbn|card|order|phone)\b")
PROVIDER = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}")
USEFUL = re.compile(r"[0-9]|[a-z][A-Z]")
# The whole value after a credential's name with = or :, quoted or up to white space, and the password part of URLs.
NAMED = re.compile(CREDENTIAL.pattern + r"""[\w\-]{0,64}["'`\])]?\s{0,4}(?:=>|:=|[=:])\s{0,4}(?:(?:bearer|basic|token)\s+)?"""
                   r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|`([^`\n]{6,})`|([^\s"'`]\S{5,}))""")
IN_URL = re.compile(r"://[^\s/:@]*:([^\s/]+)@")
NEXT_FIELD = re.compile(r"[&;,](?=[\w\-.]+=)")
#: No value but a place for one.
PLACE = re.compile(r"<[^<>]*>|\$\{[^{}]*\}?|\{\{.*|\$[A-Z_]{3,}|%[A-Z_]+%|\*+|\.+|(?i:x+|null|none|true|false|undefined)")
CALL = re.compile(r"[A-Za-z_][\w.]*\(")
ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
PLAIN_LETTERS = re.compile(r"[A-Za-z]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _letters(value: str, model: np.ndarray) -> tuple[float, float]:
    """Mean log likelihood of the letters' trigrams, and the share of them in the dictionary."""
    got: list[float] = []
    for word in PLAIN_LETTERS.findall(value):
        s = [0, 0, *(ord(c) - 96 for c in word.lower()), 0]
        got += [float(model[(a << (2 * BITS)) | (b << BITS) | c]) for a, b, c in zip(s, s[1:], s[2:])]
    return (sum(got) / len(got), sum(x >= np.log(COMMON) for x in got) / len(got)) if got else (-20.0, 0.0)


def places(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, found by context alone) of each candidate, in order; one by context may hold others."""
    runs = {m.span() for m in CANDIDATE.finditer(text) if USEFUL.search(m.group())}
    named = {m.span(1) for m in IN_URL.finditer(text)} if "://" in text else set()
    for m in NAMED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 5:
            end = start + len(NEXT_FIELD.split(text[start:end])[0].rstrip(".,;:)]}>\"'`"))
        if end - start >= 6:
            named.add((start, end))
    return sorted([(*x, False) for x in runs] + [(*x, True) for x in named - runs])


def candidates(text: str, source: str | None, model: np.ndarray):
    """(start, end, features, label) of each candidate; label 1 secret, 0 harmless, None open."""
    for start, end, named in places(text):
        value = text[start:end]
        n = len(value)
        before, after = text[max(0, start - 48):start], text[end:end + 24]
        near = before[-32:]
        digits, capitals, small = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
        counts = np.unique(list(value), return_counts=True)[1] / n
        likely, coverage = _letters(value, model)
        assigned = bool(ASSIGNED.search(before))
        name = CREDENTIAL.search(near)
        known = named or name is not None
        harmless = bool(HARMLESS.search(near) or HARMLESS.search(after))
        hexed = all(c in "0123456789abcdefABCDEF" for c in value)
        checksum = digits == n and _luhn(value)
        family = bool(PROVIDER.fullmatch(value))
        path = "/" in value.strip("/") and coverage > 0.5 or before[-1:] in ("/", "\\") or bool(source and "/" in source)
        between = len(before[before.rfind(name.group()):].split()) if name else 9
        x = [n, digits / n, capitals / n, small / n, (n - digits - capitals - small) / n, hexed, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
             float(-(counts * np.log2(counts)).sum()), likely, coverage, assigned, before[-1:] in "\"'`" and bool(before), known, harmless, path, checksum, family, between]
        label = None
        if named:  # a word of the language may be prose or a password: only what cannot be both is settled
            bare = before[-1:] not in ("\"", "'", "`")
            if PLACE.fullmatch(value) or (bare and CALL.match(value)) or (bare and before[-1:] != "=" and value.isalpha() and coverage > 0.9):
                label = 0
            elif USEFUL.search(value) and not harmless:
                label = 1
        elif family or (assigned and name and not harmless):
            label = 1
        elif digits == n or harmless or coverage > 0.9 or (not assigned and name is None and n - digits <= 2):
            label = 0
        yield start, end, [float(v) for v in x], label


def findings(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, start, end, value_hash, features, label) of all candidates in rows (doc_id, text, source)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source"))):
                for start, end, x, label in candidates(text or "", source, sent.value):
                    out.append((doc_id, start, end, xxhash.xxh64_intdigest(text[start:end].encode()) - (1 << 63), x, label))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "value_hash", "features", "label"])

    return _thin(docs).mapInArrow(run, "doc_id long, start long, end long, value_hash long, features array<double>, label long")


def _thin(docs: DataFrame) -> DataFrame:
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("source"))


def dictionary(docs: DataFrame) -> np.ndarray:
    """Log likelihood of each letter trigram over all documents."""
    return learn(docs.where("text is not null").select("text", F.lit("all").alias("lang")))[1][:, 0] if not docs.isEmpty() else np.full(GRAMS, -np.log(GRAMS), np.float32)


def train(found: DataFrame, train_rows: int = 10_000, trees: int = 24, depth: int = 7, seed: int = 11) -> list[dict] | None:
    """The forest as arrays, one dict a tree; None without findings of both labels.  found: features, label, value_hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = found.where("label is not null").select(F.col("label").cast("double").alias("label"), "features", "value_hash").dropDuplicates(["value_hash"])
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("value_hash", F.lit(seed))).limit(train_rows) for v in (0.0, 1.0)]
    rows = stored(parts[0].unionByName(parts[1]).select("label", array_to_vector("features").alias("x"), "value_hash"))
    if rows.select("label").distinct().count() < 2:
        return None
    rows = rows.coalesce(8).sortWithinPartitions("value_hash")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(rows)
    path = shared(found.sparkSession)
    model.write().save(path)
    nodes = found.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # trees x 2 ** depth at most
    forest = []
    for t in range(trees):
        own = sorted((r for r in nodes if r["treeID"] == t), key=lambda r: r["id"])
        split = [r["split"] for r in own]
        forest.append({"feature": np.array([s["featureIndex"] for s in split]),
                       "cut": np.array([s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in split]),
                       "left": np.array([r["leftChild"] for r in own]), "right": np.array([r["rightChild"] for r in own]),
                       "share": np.array([r["impurityStats"][1] / max(1e-9, sum(r["impurityStats"])) for r in own])})
    return forest


def vote(forest: list[dict] | None, x: np.ndarray, labels: list) -> np.ndarray:
    """Mean share of secrets in the leaves; without a forest the labels decide."""
    if forest is None:
        return np.array([1.0 if v == 1 else 0.0 for v in labels])
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = tree["feature"][at]
            go = f >= 0
            if not go.any():
                break
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree["cut"][at]
            at = np.where(go, np.where(left, tree["left"][at], tree["right"][at]), at)
        total += tree["share"][at]
    return total / len(forest)


def scan(docs: DataFrame, labelled: DataFrame | None = None, train_rows: int = 10_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, value_hash, label, score, is_secret of every candidate in ``docs`` (doc_id, text, source).
    ``labelled``: findings (features, label, value_hash) to train on instead of the settled ones."""
    found = stored(findings(docs, dictionary(docs)))
    forest = train(found if labelled is None else labelled, train_rows)

    def run(frames):
        for x in frames:
            if len(x):
                labels = [None if v != v else v for v in x["label"].astype("float64")]
                x["score"] = vote(forest, np.array(x["features"].tolist(), dtype=np.float64), labels)
                x["is_secret"] = x["score"] >= threshold
                x["label"] = x["label"].astype("Int64")
                x["doc_id"] = x["doc_id"].astype("Int64")
                yield x[["doc_id", "start", "end", "value_hash", "label", "score", "is_secret"]]

    return found.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id long, start long, end long, value_hash long, label long, score double, is_secret boolean")


def redacted(docs: DataFrame, train_rows: int = 10_000, threshold: float = 0.5, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with ``mask`` in place of every secret."""
    model = dictionary(docs)
    forest = train(stored(findings(docs, model).where("label is not null").select("features", "label", "value_hash")), train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    has_source = "source" in docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            sources = batch.column("source").to_pylist() if has_source else [None] * len(texts)
            sources = [None if s is None else str(s) for s in sources]
            got = [(i, *c) for i, (t, s) in enumerate(zip(texts, sources)) if t for c in candidates(t, s, sent.value)]
            if got:
                scores = vote(forest, np.array([g[3] for g in got]), [g[4] for g in got])
                spans: list[list[int]] = []
                for (i, start, end, _, _), score in zip(got, scores):
                    if score < threshold:
                        continue
                    if spans and spans[-1][0] == i and start < spans[-1][2]:  # one holds the other
                        spans[-1][2] = max(end, spans[-1][2])
                    else:
                        spans.append([i, start, end])
                for i, start, end in reversed(spans):
                    texts[i] = texts[i][:start] + mask + texts[i][end:]
                names = batch.schema.names
                batch = batch.set_column(names.index("text"), "text", pa.array(texts, batch.schema.field("text").type))
                if "n_chars" in names:
                    at = names.index("n_chars")
                    changed = {g[0] for g, s in zip(got, scores) if s >= threshold}
                    n = [len(texts[i]) if i in changed else v for i, v in enumerate(batch.column(at).to_pylist())]
                    batch = batch.set_column(at, "n_chars", pa.array(n, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
