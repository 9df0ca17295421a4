"""Subject areas of documents.

Curated, weighted subject terms are matched with one multi-pattern automaton, the longest at each place. A sentence is
about the subject whose terms weigh most in it; a term's weight is the curated one times its rarity in the corpus,
divided by the number of its subjects. Ties between subjects go to the one of the nearest sentence that is settled. A
document treats each subject that has at least ``least_sentences`` sentences and ``least_share`` of all its sentences.

In which sense a term is used is told by the words beside it, from the corpus alone: where a term with the same two
words on either side is common, but most documents with it don't treat any subject of the term, it has another sense
there (a stock phrase, an idiom) and doesn't count. Contexts too rare to tell keep the sense of the term.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.automaton import PhraseMatcher
from lexloom.session import checkpointed

TERMS_FILE = os.path.join(os.path.dirname(__file__), "subject_terms.tsv")
MOST_TERMS = 50_000
#: A context is judged if it is in this share of all documents, so that few of them are ever gathered (at most the
#: terms found in a document on average, divided by this share), and if the share of its documents that treat the
#: subject is below ``LEAST_TREATED`` even at the upper end of its confidence interval (Z standard errors).
LEAST_CONTEXT, LEAST_TREATED, Z = 0.002, 0.5, 1.96
WORDS_BESIDE = 2
#: Thresholds; :func:`calibrate` finds the share on labelled documents.
LEAST_SENTENCES, LEAST_SHARE = 2, 0.2
OPTIONS = re.compile(r"([.?!])\s+((?:\([A-Z]\)\s+\w+\s*)+)", re.I)
LIST_MARK = re.compile(r"^[^\S\n]*(?:\d+[.)]|[A-Z]:)[^\S\n]+", re.M)
BREAK = re.compile(r"(?<=[.?!])\s+|\n+|(?<=[。？！])")
CONTENT = re.compile(r"[^\W\d_]{2}|[一-鿿]")
HEADING = re.compile(r"\s*(?:unit|chapter|lesson|section)\s+\d+\s*[·:.–-]", re.I)
DIGITS = re.compile(r"\d+")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def read_terms(path: str = TERMS_FILE) -> list[tuple[str, str, float]]:
    """(term, subject, weight) of a term file: subject, language, weight and terms, separated by tabs."""
    out = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if not line.startswith("#") and line.strip():
                subject, _, weight, terms = line.rstrip("\n").split("\t")
                out += [(term.strip().lower(), subject, float(weight)) for term in terms.split(";") if term.strip()]
    if len(out) > MOST_TERMS:
        raise ValueError("too many subject terms")
    return out


def sentences(text: str) -> list[str]:
    """Sentences of a text in lower case; list marks and headings aside, answer options go with their question."""
    text = LIST_MARK.sub("", OPTIONS.sub(r" \2\1 ", text))
    return [" ".join(s.lower().split()) for s in BREAK.split(text) if s and CONTENT.search(s) and not HEADING.match(s)]


class SubjectMatcher:
    """Finds the terms of each sentence as numbers into ``names``, each with a key of its context."""

    def __init__(self, terms: list[tuple[str, str, float]]):
        self.names = sorted({t for t, *_ in terms})
        forms: dict[str, int] = {}
        for number, term in enumerate(self.names):
            forms[term] = number
        for number, term in enumerate(self.names):
            if term.isascii():
                forms.setdefault(term + ("es" if term.endswith(("s", "x", "ch", "sh")) else "s"), number)
        self._matcher = PhraseMatcher(forms.items(), free=lambda p: bool(UNSPACED.match(p)))

    def match(self, text: str) -> tuple[int, list[list[tuple[int, int]]]]:
        """Number of sentences, and the distinct (term, context) of each sentence that has any."""
        own = sentences(text)
        if not own:
            return 0, []
        starts, at = [], 0
        for s in own:
            starts.append(at)
            at += len(s) + 1
        whole = "\n".join(own)
        found: dict[int, set[tuple[int, int]]] = {}
        last = 0
        for start, end, number in sorted(self._matcher.hits(whole), key=lambda h: (h[0], -h[1])):
            if end <= last:
                continue  # inside a longer term
            last = end
            k = bisect_right(starts, start) - 1
            found.setdefault(k, set()).add((number, _context(whole, start, end, starts[k], starts[k] + len(own[k]))))
        return len(own), [sorted(found[k]) for k in sorted(found)]


def _context(text: str, start: int, end: int, low: int, high: int) -> int:
    """Key of a term with the words beside it in its sentence, numbers as if equal; unspaced scripts count signs."""
    a, b = start - 1, end
    if UNSPACED.match(text, start):
        a, b = max(low, start - 2 * WORDS_BESIDE) - 1, min(high, end + 2 * WORDS_BESIDE)
    else:
        for _ in range(WORDS_BESIDE):
            a = text.rfind(" ", low, a) if a > low else -1
            if a < 0:
                a = low - 1
                break
        for _ in range(WORDS_BESIDE):
            b = text.find(" ", b + 1, high) if b < high else -1
            if b < 0:
                b = high
                break
    return xxhash.xxh3_64_intdigest(DIGITS.sub("0", text[a + 1 : b]) + f"\n{text[start:end]}") >> 1


def subject_counts(terms: list[list[int]], weights: list[list[tuple[str, float]]]) -> Counter:
    """Number of sentences about each subject.

    A sentence between several subjects goes to the one that the nearest settled sentence is about, the earlier one
    at equal distance; subjects of a single passing sentence come after others. If no sentence of the text settles it,
    it counts for none.
    """
    about: list[str | None] = []
    open_: dict[int, set[str]] = {}
    for numbers in terms:
        evidence: Counter = Counter()
        for n in numbers:
            for subject, weight in weights[n]:
                evidence[subject] += weight
        most = max(evidence.values(), default=0)
        best = [s for s, e in evidence.items() if e > most - 1e-9]
        if len(best) > 1:
            open_[len(about)] = set(best)
        about.append(best[0] if len(best) == 1 else None)
    counts = Counter(s for s in about if s)
    places: dict[str, list[int]] = {}
    for i, subject in enumerate(about):
        if subject:
            places.setdefault(subject, []).append(i)
    for i, best in open_.items():
        near = []
        able = best & places.keys()
        for subject in {s for s in able if len(places[s]) >= LEAST_SENTENCES} or able:
            own = places[subject]
            k = bisect_right(own, i)
            near += [(abs(i - j), j, subject) for j in own[max(0, k - 1) : k + 1]]
        if near:
            counts[min(near)[2]] += 1
    return counts


def matched_terms(documents: DataFrame, terms: list[tuple[str, str, float]]) -> DataFrame:
    """(doc_id, n_sentences, sentences, terms, contexts) of every document with a non-blank text, one place a term found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = SubjectMatcher(terms)
        for batch in batches:
            sizes, ends, flat = array("i"), array("i", [0]), (array("i"), array("i"), array("q"))
            for text in batch.column("text").to_pylist():
                n, found = tool.match(text)
                sizes.append(n)
                for k, own in enumerate(found):
                    for term, context in own:
                        flat[0].append(k)
                        flat[1].append(term)
                        flat[2].append(context)
                ends.append(len(flat[0]))
            lists = [pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(x))) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.asarray(sizes)), *lists],
                ["doc_id", "n_sentences", "sentences", "terms", "contexts"],
            )

    return (
        documents.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S"))
        .select("doc_id", "text")
        .mapInArrow(run, "doc_id long, n_sentences int, sentences array<int>, terms array<int>, contexts array<long>")
    )


def _by_document(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[int]], list[list[int]]]]:
    """(document, number of sentences, terms of each sentence, their contexts)."""
    ends = batch.column("terms").offsets.to_pylist()
    places, terms, contexts = (batch.column(c).values.to_pylist() for c in ("sentences", "terms", "contexts"))
    for i, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n_sentences").to_pylist())):
        found: list[list[int]] = []
        beside: list[list[int]] = []
        for k in range(ends[i], ends[i + 1]):
            if places[k] == len(found):
                found.append([])
                beside.append([])
            found[-1].append(terms[k])
            beside[-1].append(contexts[k])
        yield doc, n, found, beside


def term_weights(terms: list[tuple[str, str, float]], total: int, frequency: dict[int, int]) -> list[list[tuple[str, float]]]:
    """(subject, weight) of each term by its number: curated weight, rarity among ``total`` documents, number of subjects."""
    of: dict[str, dict[str, float]] = {}
    for term, subject, weight in terms:
        of.setdefault(term, {}).setdefault(subject, weight)
    rarity = [math.log1p(total / frequency.get(n, 1)) / math.log1p(total or 1) for n in range(len(of))]
    return [[(s, w * rarity[n] / len(of[name])) for s, w in of[name].items()] for n, name in enumerate(sorted(of))]


def other_senses(
    matched: DataFrame, weights: list[list[tuple[str, float]]], total: int, least_sentences: int, least_share: float
) -> frozenset[int]:
    """Contexts in which a term has another sense (see the head of this module); counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_of: Counter = Counter()
            treated: Counter = Counter()
            for _, n, found, contexts in _by_document(batch):
                counts = subject_counts([list(dict.fromkeys(x)) for x in found], weights)
                treats = {s for s, c in counts.items() if c >= least_sentences and c >= least_share * n}
                own = {c: t for ts, cs in zip(found, contexts) for t, c in zip(ts, cs)}
                n_of.update(own.keys())
                treated.update(c for c, t in own.items() if any(s in treats for s, _ in weights[t]))
            columns = [list(n_of), list(n_of.values()), [treated[c] for c in n_of]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["context", "n", "k"])

    counts = matched.where(F.size("terms") > 0).mapInArrow(count, "context long, n long, k long")
    n, k = F.col("n"), F.col("k")
    upper = (k + Z * Z / 2 + Z * F.sqrt(k * (n - k) / n + Z * Z / 4)) / (n + Z * Z)  # of the Wilson interval
    common = counts.groupBy("context").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(n >= LEAST_CONTEXT * total)
    return frozenset(r["context"] for r in common.where(upper < LEAST_TREATED).select("context").collect())


def subject_shares(
    documents: DataFrame,
    terms: list[tuple[str, str, float]],
    least_sentences: int = LEAST_SENTENCES,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """(doc_id, subject, n_about, share) for every subject with at least one sentence.

    The terms found are kept in a checkpoint, as the corpus counts and the scoring read them. Document frequencies and
    contexts are counted over all documents; the former are as many as the term file has terms. ``least_sentences`` and
    ``least_share`` tell which subjects a document treats where the senses of terms are judged.
    """
    matched = checkpointed(matched_terms(documents, terms))
    total = matched.count()
    counted = (
        matched.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().collect()
    )
    weights = term_weights(terms, total, {row["term"]: row["count"] for row in counted})
    hidden = other_senses(matched, weights, total, least_sentences, least_share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, names, about, shares = [], [], [], []
            for doc, n, found, contexts in _by_document(batch):
                told = [
                    list(dict.fromkeys(t for t, c in zip(ts, cs) if c not in hidden)) for ts, cs in zip(found, contexts)
                ]
                for subject, count in sorted(subject_counts(told, weights).items()):
                    docs.append(doc)
                    names.append(subject)
                    about.append(count)
                    shares.append(count / n)
            columns = [pa.array(docs, pa.int64()), pa.array(names, pa.string()), pa.array(about, pa.int32()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "subject", "n_about", "share"])

    return matched.where(F.size("terms") > 0).mapInArrow(
        score, "doc_id long, subject string, n_about int, share double"
    )


def assign_subjects(
    documents: DataFrame,
    subjects: DataFrame,
    terms: list[tuple[str, str, float]] | None = None,
    least_sentences: int = LEAST_SENTENCES,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """(doc_id, subject_id, n_about, share) of every subject that a document treats.

    Null, empty and blank texts have none, nor have texts without terms. A subject of the term file that
    ``subjects`` doesn't name is left out. Repeated documents give repeated rows.
    """
    shares = subject_shares(documents, terms or read_terms(), least_sentences, least_share)
    kept = shares.where((F.col("n_about") >= least_sentences) & (F.col("share") >= least_share))
    return kept.join(subjects.select("subject_id", "subject").dropDuplicates(["subject"]), "subject").select(
        "doc_id", "subject_id", "n_about", "share"
    )


def calibrate(shares: DataFrame, labels: DataFrame, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """(part, least_share, labels, found, both, precision, recall) of the two halves of the labelled documents.

    ``least_share`` is fitted on one half, chosen by a hash of the document: the share of the best F1, the middle one
    where several are best. The other half is held out. ``labels`` are (doc_id, subject); repeated ones count once.
    Labels may be incomplete, so the precision is a lower bound. Only counts by hundredths of the share are gathered.
    """
    spark = shares.sparkSession
    known = labels.where(F.col("subject").isNotNull()).select("doc_id", "subject").distinct()
    of_labelled = shares.where(F.col("n_about") >= least_sentences).join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, "fitted").otherwise("held out").alias("part")
    pairs = known.withColumn("label", F.lit(1)).join(
        of_labelled.select("doc_id", "subject", "share").distinct(), ["doc_id", "subject"], "full"
    )
    step = F.floor(F.col("share") * 100 + 1e-9).cast("int").alias("step")
    counted = pairs.groupBy(part, step).agg(F.count("label").alias("labels"), F.count("*").alias("pairs")).collect()

    def counts(name: str, least: int) -> tuple[int, int, int]:
        own = [r for r in counted if r["part"] == name]
        found = [r for r in own if r["step"] is not None and r["step"] >= least]
        return sum(r["labels"] for r in own), sum(r["pairs"] for r in found), sum(r["labels"] for r in found)

    def f1(least: int) -> float:
        labelled, found, both = counts("fitted", least)
        return 2 * both / (labelled + found) if labelled + found else 0.0

    best = max(map(f1, range(1, 101)))
    same = [k for k in range(1, 101) if f1(k) == best]
    least = same[len(same) // 2]
    rows = []
    for name in ("fitted", "held out"):
        labelled, found, both = counts(name, least)
        precision = both / found if found else None
        rows.append((name, least / 100, labelled, found, both, precision, both / labelled if labelled else None))
    return spark.createDataFrame(
        rows, "part string, least_share double, labels long, found long, both long, precision double, recall double"
    )
