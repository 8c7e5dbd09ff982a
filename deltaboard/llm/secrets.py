"""Secrets in texts: broad candidate patterns, and a random forest that removes false positives."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaboard.session import Staging

#: Up to this many bytes, as counted, findings are sent to the texts when they are redacted.
BROADCAST_BYTES = 32 << 20
DICTIONARY = 30_000
LABELLED = 20_000
TREES = 20
DEPTH = 6
LEAST_SCORE = 0.5

# Names that announce a credential, words that announce an example, and public key formats.
NAMES = "token secret passwd password passphrase pwd api_key apikey api-key access_key private_key auth credential client_secret".split()
EXAMPLES = frozenset("example sample test dummy fake placeholder changeme todo fixture mock your redacted checksum sha1 sha256 md5 commit digest uuid".split())
FORMATS = {
    "aws_key": r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "json_web_token": r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]+",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----",
}
HINT = re.compile("AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ|-----BEGIN")
FORMAT = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in FORMATS.items()))
NAMED = re.compile(r"(?:" + "|".join(NAMES) + r")[\w-]{0,64}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?([^\s\"'<>,;]{6,})", re.IGNORECASE)
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGITS = re.compile(r"\d")
PIECES = re.compile(r"[a-z]{3,}")
FEATURES = [
    "length", "transition", "coverage", "digits", "upper", "entropy", "named", "assigned", "quoted", "example",
    "path_words", "path_example", "near_words", "format",
]


def common_words(docs: DataFrame, words: int = DICTIONARY) -> DataFrame:
    """``word, n``: the words in most documents of the whole corpus, at most ``words`` of them."""
    parts = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    return (
        docs.where("text is not null")
        .select(F.explode(parts).alias("word"))
        .where(F.length("word").between(3, 14))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(words)
    )


class WordModel:
    """Dictionary coverage, and log shares of letter transitions, from the common words."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(counts)
        pairs, ones = Counter(), Counter()
        for word, n in counts.items():
            weight = 1 + math.log(n)
            for a, b in zip(word, word[1:]):
                pairs[a, b] += weight
                ones[a] += weight
        self.pairs = {ab: math.log((n + 1) / (ones[ab[0]] + 27)) for ab, n in pairs.items()}
        self.rare = math.log(1e-4)

    def transition(self, value: str) -> float:
        low = value.lower()
        steps = [self.pairs.get((a, b), self.rare) for a, b in zip(low, low[1:])]
        return sum(steps) / len(steps) if steps else self.rare

    def coverage(self, value: str) -> float:
        """Share of the characters in dictionary words, longest first from the left."""
        covered = 0
        for run in PIECES.findall(value.lower()):
            at = 0
            while at < len(run) - 2:
                size = next((s for s in range(min(14, len(run) - at), 2, -1) if run[at : at + s] in self.words), 0)
                covered += size
                at += size or 1
        return covered / max(1, len(value))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping ``(start, end, kind)`` of everything that may be a secret."""
    found = []
    if HINT.search(text):
        found += [(m.start(), m.end(), m.lastgroup) for m in FORMAT.finditer(text)]
    found += [(m.start(1), m.end(1), "named") for m in NAMED.finditer(text)]
    for m in BARE.finditer(text):
        if len(DIGITS.findall(m.group())) >= 2:
            found.append((m.start(), m.end(), "bare"))
    order = {"named": 1, "bare": 2}
    found.sort(key=lambda f: (f[0], order.get(f[2], 0), -f[1]))
    kept: list[tuple[int, int, str]] = []
    for start, end, kind in found:
        if kept and start < kept[-1][1]:
            if end > kept[-1][1] and kept[-1][2] == "named" and kind not in order:
                kept[-1] = (kept[-1][0], end, kind)
            continue
        kept.append((start, end, kind))
    return kept


def features(text: str, start: int, end: int, kind: str, path: str, model: WordModel) -> list[float]:
    value = text[start:end]
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    low = before.lower()
    shares = [n / len(value) for n in Counter(value).values()]
    near = re.findall(r"[a-z]{3,}", low)[-4:] + re.findall(r"[a-z]{3,}", after.lower())[:2]
    place = re.findall(r"[a-z0-9]+", path.lower())
    return [
        float(min(len(value), 4096)),
        model.transition(value),
        model.coverage(value),
        sum(c.isdigit() for c in value) / len(value),
        sum(c.isupper() for c in value) / len(value),
        -sum(s * math.log2(s) for s in shares),
        float(any(name in low[-32:] for name in NAMES)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and before != ""),
        float(any(w in EXAMPLES for w in near) or "example" in value.lower() or "xxxx" in value.lower()),
        float(sum(w in model.words for w in place)),
        float(any(w in EXAMPLES or w in ("docs", "tests", "spec") for w in place)),
        sum(w in model.words for w in near) / max(1, len(near)),
        float(kind not in ("named", "bare")),
    ]


def find_candidates(docs: DataFrame, words: DataFrame, path: str = "source") -> DataFrame:
    """``doc_id, mark, start, end, kind, digest, values``: candidates of whole texts with their features.

    ``words`` (at most ``DICTIONARY`` rows) goes to every task.
    """
    counts = {r["word"]: r["n"] for r in words.collect()}
    sent = docs.sparkSession.sparkContext.broadcast(WordModel(counts))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            rows = []
            for doc, mark, place, text in zip(batch["doc_id"], batch["mark"], batch["path"], batch["text"]):
                for start, end, kind in candidates(text):
                    digest = hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc, mark, start, end, kind, digest, features(text, start, end, kind, place, model)))
            names = ["doc_id", "mark", "start", "end", "kind", "digest", "values"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return (
        docs.where("text is not null")
        .select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("mark"), F.coalesce(F.col(path), F.lit("")).alias("path"), "text")
        .mapInPandas(find, "doc_id long, mark string, start int, end int, kind string, digest string, values array<double>")
    )


def rule_labels(found: DataFrame, most: int = LABELLED) -> DataFrame:
    """``values, label``: labelled findings where none are given, by rules that each see only clear cases.

    Positive: a value in a published format, or one behind a credential's name that is
    assigned, with digits and little of it in the dictionary. Negative: a value of
    dictionary words, one next to a word for examples or digests, or one of digits
    alone. Findings between these are not labelled. At most ``most`` of each label,
    chosen by digest.
    """
    value = {name: F.get("values", F.lit(k)) for k, name in enumerate(FEATURES)}
    example = (value["example"] > 0) | (value["path_example"] > 0)
    positive = ((value["format"] > 0) | ((value["named"] > 0) & (value["assigned"] > 0) & (value["digits"] > 0) & (value["coverage"] < 0.4))) & ~example
    negative = (value["coverage"] > 0.6) | example | (value["digits"] == 1.0) | ((value["named"] == 0) & (value["format"] == 0) & (value["assigned"] == 0))
    label = F.when(positive, 1.0).when(negative, 0.0)
    labelled = found.select("digest", "values", label.alias("label")).where("label is not null").dropDuplicates(["digest"])
    parts = [labelled.where(F.col("label") == k).orderBy("digest").limit(most) for k in (0.0, 1.0)]
    return parts[0].unionByName(parts[1]).select("values", "label")


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("values"))


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | None:
    """A forest on ``values, label``; None unless both labels occur."""
    if labelled.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt")
    return forest.fit(_vectors(labelled))


def scan_secrets(
    docs: DataFrame,
    stage: Staging,
    labelled: DataFrame | None = None,
    path: str = "source",
    least_score: float = LEAST_SCORE,
) -> DataFrame:
    """``doc_id, mark, start, end, kind, digest, score``: the findings in ``docs(doc_id, text, <path>)``.

    ``start`` and ``end`` are code points of the text, ``digest`` is the SHA-256 of
    the value; the value itself is not returned. ``mark`` is the SHA-256 of the text
    and tells rows with one doc_id apart. The dictionary and the letter transitions come
    from all documents. The forest is trained on ``labelled(values, label)``, or by
    default on findings that ``rule_labels`` is sure of. Without both labels the
    candidates behind a credential's name or in a published format are returned with
    score 1, others not at all.

    A null or empty text has no findings, a null path is empty, repeated rows each
    get theirs. An empty table gives no rows. Other columns are ignored.
    """
    words = stage(common_words(docs), "dictionary")
    found = stage(find_candidates(docs, words, path), "candidates")
    if labelled is None:
        labelled = stage(rule_labels(found), "labelled")
    forest = train_forest(labelled)
    names = ["doc_id", "mark", "start", "end", "kind", "digest"]
    if forest is None:
        return found.where("kind <> 'bare'").select(*names, F.lit(1.0).alias("score"))
    judged = forest.transform(_vectors(found))
    return judged.select(*names, F.get(vector_to_array("probability"), F.lit(1)).alias("score")).where(
        F.col("score") >= least_score
    )


def redact(docs: DataFrame, findings: DataFrame, columns: list[str], filler: str = "[secret]") -> DataFrame:
    """``columns`` of ``docs`` with every finding in ``text`` replaced; rows without findings are as they were.

    Rows meet their findings by doc_id, null or not, and text, so rows that share
    an id each lose their own secrets and nothing else. Repeated rows stay repeated.
    The findings are sent to the texts while they take at most ``BROADCAST_BYTES``,
    so that the texts need not move; beyond that both sides shuffle.
    """
    spans = findings.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_of", "mark": "_mark"})
    # A finding with its row's id and digest takes less than 200 bytes.
    if findings.count() * 200 <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    marked = docs.select(*columns).withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    pieces = F.transform(
        "spans",
        lambda s, i: F.concat(
            F.substring("text", F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))),
            F.lit(filler),
        ),
    )
    rest = F.substring("text", F.get("spans", F.size("spans") - 1)["end"] + 1, F.length("text"))
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    same = (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_of"))
    return marked.join(spans, same, "left").withColumn("text", clean).select(*columns)
