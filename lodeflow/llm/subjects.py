"""Subject areas by class-association rules.

Sentences of labelled documents become transactions of terms and the document's subject. Terms are substrings of 2 to 5
Chinese characters, and words and pairs of words elsewhere, that are frequent and lean to one subject; each sentence is cut
into them from the left, the longest first. Frequent patterns with a subject are mined by parallel frequent-pattern growth,
from the conditional base of each term, as deep as rules have terms; a rule that is no surer than one with fewer terms is redundant and pruned. A rule's evidence is its log-odds ratio,
calibrated by smoothed counts. Every document is scored sentence by sentence: a sentence counts, by its length, for the
subject with the most evidence, and a document has each subject whose share of it reaches a threshold calibrated on the
labelled documents.

Rules are fitted on at most ``LABELLED`` labelled documents, by the order of a hash of their ids; all documents are scored,
on their whole texts. Labels are trimmed and put in lower case; unknown or NULL labels and repeated rows don't count;
documents labelled with several subjects serve the threshold only.

Defined results: NULL, empty, blank and junk texts have no subject, nor do rows without id; repeated rows give each pair
once; without labelled documents there are no rules and no rows. Ties go to the subject first by name. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.quality import larger_part
from lodeflow.operators.batches import spread, text_slices
from lodeflow.session import materialize

LABELLED = 5_000
#: Sentences and documents a term occurs in at least; share of its sentences in one subject; terms of a rule.
TERM_SENTENCES, TERM_DOCUMENTS, LEAN, RULE_TERMS = 5, 3, 0.4, 2
CONFIDENCE, SURER = 0.6, 0.02
#: Share of a document if there are too few labels to calibrate, and the range calibrated in.
SHARE, SHARES = 0.2, (0.14, 0.25)
_SENTENCE = regex.compile(r"[。！？!?\n\r]+|\.(?=\s|$)")
_RUNS = regex.compile(r"\p{Han}+|[^\W\d_\p{Han}]+(?:['’-][^\W\d_\p{Han}]+)*", regex.V1)
_WORD = regex.compile(r"[^\W\d_\p{Han}]+(?:['’-][^\W\d_\p{Han}]+)*", regex.V1)
_LONGEST, _HAN = 5, regex.compile(r"\p{Han}")
_MARK = "="  # in front of a subject among the items


def _runs(sentence: str) -> list[str]:
    return _RUNS.findall(sentence.lower())


def all_terms(sentence: str) -> set[str]:
    """Every possible term of a sentence."""
    out: set[str] = set()
    before = None
    for run in _runs(sentence):
        if _HAN.match(run):
            for n in range(2, _LONGEST + 1):
                out.update(run[k : k + n] for k in range(len(run) - n + 1))
            before = None
        else:
            out.add(run)
            if before:
                out.add(f"{before} {run}")
            before = run
    return out


class Cutter:
    """Cuts texts into known terms: from the left, the longest first, without overlap. Chinese terms are found by one pass
    of an automaton over the text, others word by word, pairs before single words."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.signs = sorted(t for t in terms if _HAN.match(t))
        self.words = frozenset(t for t in terms if not _HAN.match(t))
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for t in self.signs:
                self._automaton.add_word(t, t)
            self._automaton.make_automaton()
        return self._automaton

    def __call__(self, text: str) -> tuple[list[int], list[list[str]]]:
        """(length in characters other than blanks, terms) of each sentence."""
        low = text.lower()
        ends, sizes, start = [], [], 0
        for mark in _SENTENCE.finditer(low):
            ends.append(mark.start())
            sizes.append(mark.start() - start - low.count(" ", start, mark.start()))
            start = mark.end()
        ends.append(len(low))
        sizes.append(len(low) - start - low.count(" ", start))
        found: list[list[str]] = [[] for _ in ends]
        if self.signs:
            k = 0
            for end, term in self.automaton.iter_long(low):
                while end >= ends[k]:
                    k += 1
                found[k].append(term)
        if self.words:
            k, before = 0, None
            words = self.words
            for word in _WORD.finditer(low):
                at = word.start()
                if at >= ends[k]:
                    if before is not None and before in words:
                        found[k].append(before)
                    before = None
                    while at >= ends[k]:
                        k += 1
                w = word[0]
                if before is None:
                    before = w
                elif (pair := f"{before} {w}") in words:
                    found[k].append(pair)
                    before = None
                else:
                    if before in words:
                        found[k].append(before)
                    before = w
            if before is not None and before in words:
                found[k].append(before)
        return sizes, found


class Rules:
    """Pruned rules and the share of a document that makes a subject."""

    def __init__(self, rules: dict[tuple[str, ...], list[tuple[str, float]]], share: float = SHARE) -> None:
        self.single = {k[0]: v for k, v in rules.items() if len(k) == 1}
        self.pairs = {k: v for k, v in rules.items() if len(k) == 2}
        self.paired = {t for k in self.pairs for t in k}
        self.cut = Cutter([*self.single, *self.paired])
        self.share = share

    def shares(self, text: str) -> dict[str, float]:
        """Share of the visible characters in sentences of each subject."""
        weight: Counter[str] = Counter()
        sizes, found = self.cut(text)
        single, paired, pairs = self.single, self.paired, self.pairs
        for size, terms in zip(sizes, found):
            if not terms:
                continue
            evidence: dict[str, float] = defaultdict(float)
            own = set(terms)
            for t in own:
                for subject, w in single.get(t, ()):
                    evidence[subject] += w
            some = sorted(own & paired)
            for i, a in enumerate(some):
                for b in some[i + 1 :]:
                    for subject, w in pairs.get((a, b), ()):
                        evidence[subject] += w
            if evidence:
                weight[min(evidence, key=lambda s: (-evidence[s], s)) if len(evidence) > 1 else next(iter(evidence))] += size
        total = max(1, sum(sizes))
        return {s: n / total for s, n in weight.items()}

    def subjects(self, text: str | None) -> list[str]:
        if not text or not text.strip() or not (self.single or self.pairs):
            return []
        found = sorted(s for s, v in self.shares(text).items() if v >= self.share)
        return [] if found and _may_be_junk(text) and larger_part(text) == "junk" else found


def _may_be_junk(text: str) -> bool:
    """Cheap and inclusive: repeated tokens, hardly any marks of sentences, or many odd signs."""
    tokens = text.split()
    ends = sum(text.count(c) for c in "。.，,；;")
    return len(set(tokens)) < 0.5 * len(tokens) or ends * 60 < len(text) or sum(text.count(c) for c in "�□锟拷") > 3


def labelled_documents(documents: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED) -> DataFrame:
    """(``id``, ``text``, ``subjects``) of at most ``limit`` labelled documents."""
    known = subjects.select(F.trim("subject").alias("subject")).where("subject IS NOT NULL").distinct()
    clean = labels.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.trim("subject")).alias("low"))
    clean = clean.join(known.select(F.lower("subject").alias("low"), "subject"), "low").where("id IS NOT NULL")
    chosen = clean.groupBy("id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    # at most ``limit`` ids, whatever the tables hold
    return materialize(rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"]), "labelled")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for text, subject in zip(batch.column("text").to_pylist(), batch.column("subject").to_pylist()):
            own: set[str] = set()
            for sentence in _SENTENCE.split(text):
                for t in all_terms(sentence):
                    c = counts.setdefault((t, subject), [0, 0])
                    c[0] += 1
                    if t not in own:
                        own.add(t)
                        c[1] += 1
    columns = ([k[0] for k in counts], [k[1] for k in counts], [v[0] for v in counts.values()], [v[1] for v in counts.values()])
    for k in range(0, len(columns[0]), 50_000):
        parts = [c[k : k + 50_000] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["term", "subject", "n", "docs"])


def grown_once(sentences: DataFrame) -> DataFrame:
    """(``a``, ``s``, ``n``) of each term and subject: patterns of one term. sentences: ``items``, the subject last."""
    terms = F.slice("items", F.lit(1), F.size("items") - 1)
    return sentences.select(F.element_at("items", -1).alias("s"), F.explode(terms).alias("a")).groupBy("a", "s").agg(F.count("*").alias("n"))


def grown_twice(sentences: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``s``, ``n``, ``total``): patterns of two terms that are frequent and mostly in one subject.

    The conditional base of a term ``b`` is what stands before it, in order, in each of its sentences; a term ``a`` frequent
    in it grows ``b`` to a pattern of two. Growth ends there, as rules have ``RULE_TERMS`` terms, so a sentence of t terms
    costs t * t / 2 rows, however often it is repeated. Bases are counted in parallel with partial counts.
    """
    terms = F.slice("items", F.lit(1), F.size("items") - 1)
    placed = sentences.select(F.element_at("items", -1).alias("s"), terms.alias("t")).select("s", "t", F.posexplode("t").alias("j", "b"))
    base = placed.select("s", "b", F.explode(F.slice("t", F.lit(1), F.col("j"))).alias("a")).groupBy("a", "b", "s").agg(F.count("*").alias("n"))
    grown = base.groupBy("a", "b").agg(F.max_by("s", "n").alias("s"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return grown.where((F.col("n") >= TERM_SENTENCES) & (F.col("n") >= CONFIDENCE * F.col("total")))


def fit_rules(labelled: DataFrame) -> Rules:
    """Mine, prune and calibrate. labelled: as of ``labelled_documents``; its size is bounded, so what is gathered is too."""
    spark = labelled.sparkSession
    single = labelled.where(F.size("subjects") == 1).select("text", F.col("subjects")[0].alias("subject"))
    counted = single.mapInArrow(_term_counts, "term STRING, subject STRING, n BIGINT, docs BIGINT").groupBy("term", "subject").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    frequent = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max("n").alias("most"))
    frequent = frequent.where((F.col("n") >= TERM_SENTENCES) & (F.col("docs") >= TERM_DOCUMENTS) & (F.col("most") >= LEAN * F.col("n")))
    terms = frozenset(r.term for r in frequent.select("term").collect())
    if not terms:
        return Rules({})
    sent = spark.sparkContext.broadcast(Cutter(terms))

    def transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, subject in zip(batch.column("text").to_pylist(), batch.column("subject").to_pylist()):
                out += [[*sorted(set(found)), _MARK + subject] for found in sent.value(text)[1] if found]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["items"])

    sentences = materialize(single.mapInArrow(transactions, "items ARRAY<STRING>"), "transactions")
    total = sentences.count()
    if not total:
        return Rules({})
    prior = {r.s: r.n for r in sentences.groupBy(F.element_at("items", -1).alias("s")).agg(F.count("*").alias("n")).collect()}
    counts: dict[tuple[tuple[str, ...], str | None], int] = {}
    for r in grown_once(sentences).collect():
        counts[(r.a,), r.s] = r.n
        counts[(r.a,), None] = counts.get(((r.a,), None), 0) + r.n
    for r in grown_twice(sentences).collect():
        counts[(r.a, r.b), r.s], counts[(r.a, r.b), None] = r.n, r.total

    def confidence(a: tuple[str, ...], s: str) -> float:
        return counts.get((a, s), 0) / counts[a, None] if (a, None) in counts else 0.0

    rules: dict[tuple[str, ...], list[tuple[str, float]]] = defaultdict(list)
    for (a, s), n in counts.items():
        if s is None or n < TERM_SENTENCES or confidence(a, s) < CONFIDENCE:
            continue
        if len(a) == 2 and max(confidence(a[:1], s), confidence(a[1:], s)) + SURER >= confidence(a, s):
            continue
        others = counts[a, None] - n
        rest = max(1, total - prior[s])
        rules[a].append((s[len(_MARK) :], math.log((n + 0.5) / (prior[s] + 1) * (rest + 1) / (others + 0.5))))
    fitted = Rules(dict(rules))
    fitted.share = _calibrated(labelled, fitted)
    return fitted


def _calibrated(labelled: DataFrame, rules: Rules) -> float:
    """The share that agrees best (F1) with the labels."""
    steps = [SHARES[0] + 0.01 * k for k in range(round((SHARES[1] - SHARES[0]) / 0.01) + 1)]
    sent = labelled.sparkSession.sparkContext.broadcast(rules)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[0, 0, 0] for _ in steps]
            for text, subjects in zip(batch.column("text").to_pylist(), batch.column("subjects").to_pylist()):
                shares = sent.value.shares(text)
                for k, step in enumerate(steps):
                    found = {s for s, v in shares.items() if v >= step}
                    right = len(found & set(subjects))
                    rows[k][0] += right
                    rows[k][1] += len(found) - right
                    rows[k][2] += len(subjects) - right
            columns = [list(range(len(steps))), *zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k", "tp", "fp", "fn"])

    got = labelled.mapInArrow(tally, "k BIGINT, tp BIGINT, fp BIGINT, fn BIGINT").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).collect()
    scores = {r.k: 2 * r.tp / (2 * r.tp + r.fp + r.fn) for r in got if r.tp >= 50}
    if not scores:
        return SHARE
    best = max(scores.values())
    good = [k for k, v in scores.items() if v >= best - 0.002]
    return steps[sorted(good)[len(good) // 2]]


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``subject``) of every document, in the spelling of ``subjects``."""
    rules = fit_rules(labelled_documents(documents, labels, subjects, id_col, text_col))
    sent = documents.sparkSession.sparkContext.broadcast(rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, names = [], []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    for s in rules.subjects(text):
                        ids.append(i)
                        names.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], ["id", "subject"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return spread(rows).mapInArrow(score, "id BIGINT, subject STRING").withColumnRenamed("id", id_col).distinct()
