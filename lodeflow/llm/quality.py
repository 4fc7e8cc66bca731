"""Texts that aren't natural prose: statistics, robust Mahalanobis distance, and the kind of each outlier.

1. ``stats`` measures 18 statistics of each text, once. Per language, told by the letters of a text (Chinese, Latin, others),
   mean and covariance of prose are estimated robustly over all texts: from medians and quartiles to begin with, then by
   concentration steps that keep the three quarters of the texts nearest to the mean. Sums are made by the tasks; the driver
   sees one row for each language and pair of statistics.
2. A text's squared distance is the sum of its statistics' contributions, which are reported. Texts beyond ``CUT``, a quantile
   of the distances of prose, are outliers; all others are prose.
3. The kind of an outlier is read off its contributions, with the side of the mean that each statistic is on, by a linear
   discriminant. It is calibrated on at most ``SAMPLE`` outliers, in the order of a hash, whose larger part has been looked up
   part by part. Outliers between two kinds (``MARGIN``) are looked up themselves; full sentences are prose however they are
   laid out. Outliers that read as prose keep their distance and have no kind.

Defined results: NULL, empty and blank texts and rows without id don't count and come out nowhere; repeated rows come out
repeated from ``score_texts`` and once as cases; other columns are not read; a language with few texts is measured by
scales of ``FLOOR``; with few outliers the discriminant trusts itself little, so more of them are looked up; whole texts are
used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.stats import COMMON_EN, COMMON_ZH, NAMES, measure
from lodeflow.operators.batches import spread, text_slices
from lodeflow.session import materialize

def chi_square_quantile(z: float, freedom: int) -> float:
    """By the cube-root approximation; z: the quantile of the normal distribution."""
    part = 2 / (9 * freedom)
    return freedom * (1 - part + z * part**0.5) ** 3


#: Squared distance of an outlier: what 0.7 % of prose passes if its statistics are normal (z = 2.457).
CUT = chi_square_quantile(2.457, len(NAMES))
#: Outliers the discriminant is calibrated on at most; how far the first kind must be ahead of the second.
SAMPLE, MARGIN = 4_000, 0.2
KINDS = ("prose", "list", "table", "junk")
#: Weight of the penalty on coefficients; number of outliers at which the discriminant trusts itself by half.
RIDGE, HALF_TRUST = 10.0, 500
#: Least standard deviation that counts as natural, so that a statistic that prose never shows doesn't decide alone.
FLOOR = np.array([0.4, 1.0, 0.02, 0.02, 0.04, 0.3, 0.04, 0.12, 0.5, 0.5, 0.12, 0.06, 0.1, 0.04, 0.03, 0.08, 0.3, 0.04])
STEPS, KEPT = 3, 0.75
LANGUAGES = ("zh", "en", "other")

#: Words of page furniture (fixed values).
FURNITURE = set(
    "首页 登录 注册 分享 收藏 评论 返回顶部 下一页 上一页 上一篇 下一篇 点击展开全文 关注 点赞 举报 搜索 菜单 更多".split()
    + ["home", "log in", "login", "sign up", "sign in", "register", "share", "save", "next", "previous", "comments", "back to top", "menu", "search", "more"]
)
_COMMON_ZH, _COMMON_EN = set(COMMON_ZH), set(COMMON_EN.split())
_BREAK = regex.compile(r"[\r\n\x85\u2028\u2029]+")
_CELL = regex.compile(r"[|¦\t]|</?t[dhr]\b")
_TAG = regex.compile(r"</?t[dhr]\b[^>]*>|[|¦\t]")
_ZS = regex.compile(r"\p{Zs}")
_GAP = regex.compile(r"(?<=\S)[  　]{2,}(?=\S)")
_COMMA = regex.compile(r",(?=[^\s,])")
_BORDER = regex.compile(r"[\s+|¦=:_-]*[-=]{3,}[\s+|¦=:_-]*")
_BULLET = regex.compile(r"\s*(?:[-*•·●▪◦‣–—+]\s+(?:\[[ xX]?\]\s*)?|[（(]?(?:\d{1,3}|[一二三四五六七八九十]{1,3}|[a-zA-Z])[)）.、．]\s*)(?=\S)")
_KEY = regex.compile(r"[\d\p{P}\p{S}\s]+")
_END = regex.compile(r"[。！？!?….;；][\p{Pe}\p{Pf}\"'\s]*$")
_PIECES = regex.compile(r"[，。；、：！？,;:!?|/]|\.(?!\d)|\s[>»·•–—-]\s")
_MARK = regex.compile(r"[，。；！？]|[,.;!?](?=\s|$)")
_HAN, _WORD, _LATIN = regex.compile(r"\p{Han}"), regex.compile(r"[A-Za-z][A-Za-z'’-]*"), regex.compile(r"[A-Za-z]")
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_ODD = regex.compile(r"[^\p{Han}A-Za-z\p{N}\s\p{P}]|[�□]|[#$%&*@\\^_`{|}~<>\[\]+=/]")
_FOREIGN = regex.compile(r"[\p{L}--[\p{Han}A-Za-z\p{Hiragana}\p{Katakana}\p{Hangul}]]", regex.V1)
_CONTROL = regex.compile(r"[\p{Cc}--[\t\n\r]]", regex.V1)


def _junk(block: str, visible: int) -> bool:
    """No readable content: noise, garbled or repeated signs or words."""
    odd = len(_ODD.findall(block))
    if odd > 0.35 * visible or "拷" in block and "锟" in block and odd + len(_FOREIGN.findall(block)) > 0.2 * visible:
        return True
    if visible >= 12 and (block.count("�") + block.count("□")) > 0.05 * visible and len(_CONTROL.findall(block)) > 0:
        return True
    latin = _LATIN.findall(block)
    if len(latin) >= 20 and len(latin) > 0.5 * visible and sum(c in "aeiouAEIOU" for c in latin) < 0.2 * len(latin):
        return True
    tokens = _TOKEN.findall(block.lower())
    if len(tokens) >= 10 and len(set(tokens)) < 0.35 * len(tokens) and not _junk_free(block, tokens):
        return True
    long = sum(len(t) for t in tokens if len(t) >= 24 and not _HAN.search(t))
    if long > 0.5 * visible or any(len(t) >= 24 for t in tokens) and _is_base64(block, visible):
        return True
    return visible >= 12 and len(set(_KEY.sub("", block))) <= min(4, 0.2 * visible) and len(_KEY.sub("", block)) > 0.6 * visible


def _junk_free(block: str, tokens: list[str]) -> bool:
    """Repeated tokens are natural where sentences are: a long text repeats its words, with many function words."""
    words = [t for t in tokens if t in _COMMON_EN]
    return len(words) > 0.3 * len(tokens) and len(set(tokens)) > 20


def _is_base64(block: str, visible: int) -> bool:
    return len(regex.findall(r"[A-Za-z0-9+/=]", block)) > 0.95 * visible and " " not in block.strip()


def _prose(block: str) -> bool | None:
    """Whether a block reads as sentences; None if it is too short to tell."""
    signs = _HAN.findall(block)
    words = _WORD.findall(block)
    found = [p for p in _PIECES.split(block) if _TOKEN.search(p)]
    pieces = max(1, len(found))
    lines = block.count("\n") + 1
    if len(signs) >= 2 * len(words):
        if len(signs) < 12:
            return None
        if lines > 2 and len(signs) < 8.5 * lines and len(_MARK.findall(block)) < len(signs) / 25:
            return False
        share = sum(c in _COMMON_ZH for c in signs) / len(signs)
        return share >= (0.45 if len(signs) >= 30 else 0.38) and len(signs) / pieces >= (5 if len(signs) >= 16 else 7)
    if len(words) < 6:
        return None
    if lines > 2 and len(words) < 3.3 * lines and len(_MARK.findall(block)) < len(words) / 25:
        return False
    share = sum(w.lower() in _COMMON_EN for w in words) / len(words)
    return share >= (0.3 if len(words) >= 20 else 0.25) and (len(words) / pieces >= 3.2 or max(len(_WORD.findall(p)) for p in found) >= 9)


def larger_part(text: str) -> str:
    """prose, list, table or junk: what most visible characters of the text belong to; ties in that order."""
    weight = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    lines = [x for x in _BREAK.split(_ZS.sub(" ", text)) if x.strip()]
    rows = 0
    blocks: list[list] = []  # kind or None, text
    furniture = False
    for line in lines:
        key = _KEY.sub(" ", line).strip().lower()
        if key in FURNITURE or (key and all(k in FURNITURE for k in key.split())) or furniture and not key:
            blocks.append(["junk", line])
            furniture = True
            continue
        furniture = False
        cells = len(_CELL.findall(line))
        inner = _TAG.sub(" ", line)
        if _BORDER.fullmatch(line) or cells >= 2 and len("".join(_TOKEN.findall(inner))) > 0.4 * len("".join(inner.split())):
            blocks.append(["table", line])
            rows += 1
            continue
        commas, gaps = len(_COMMA.findall(line)), len(_GAP.findall(line))
        if (commas >= 2 or gaps >= 2) and not _prose(line) and not _junk(line, len("".join(line.split()))):
            pieces = _COMMA.split(line) if commas >= gaps else _GAP.split(line)
            if max(len(p) for p in pieces) <= 40 and (gaps >= 2 or not regex.search(r", |，|、", line)):
                blocks.append(["table", line])
                rows += 1
                continue
        if _BULLET.match(line):
            blocks.append(["item", _BULLET.sub("", line, count=1)])
        elif blocks and blocks[-1][0] is None:
            blocks[-1][1] += "\n" + line
        else:
            blocks.append([None, line])
    before = None
    for kind, block in blocks:
        if kind == "table" and rows == 1:
            kind = "list"  # one row of cells is a run of entries
        visible = len("".join(block.split()))
        if kind is None or kind == "item":
            if _junk(block, visible):
                found = "junk"
            else:
                reads = _prose(block)
                if reads is None:
                    ends = bool(_END.search(block)) and kind is None
                    found = "prose" if before == "prose" and kind is None or ends and before is None else "list"
                else:
                    found = "prose" if reads else "list"
        else:
            found = kind
        weight[found] += visible
        before = found
    return max(weight, key=lambda k: weight[k])


_STATS = "id BIGINT, h BIGINT, lang INT, s BINARY"


def languages(values: np.ndarray, chinese: np.ndarray) -> np.ndarray:
    """Place in ``LANGUAGES`` of each text: Chinese from 0.3 of the letters on, others from more than half on."""
    return np.where(chinese >= 0.3, 0, np.where(values[:, NAMES.index("strange")] > 0.5, 2, 1)).astype(np.int32)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", 1_500_000):
            values, chinese, visible = measure(part.column("text").to_pylist())
            some = np.flatnonzero(visible > 0)
            rows = [r.tobytes() for r in values[some].astype(np.float32)]
            kept = part.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("h"), pa.array(languages(values, chinese)[some], pa.int32()), pa.array(rows, pa.binary())], ["id", "h", "lang", "s"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(b"".join(batch.column("s").to_pylist()), np.float32).reshape(batch.num_rows, len(NAMES)).astype(np.float64)
    return np.asarray(batch.column("lang")), s


def distances(values: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, contribution of each statistic to it)."""
    off = values - mean
    parts = off * (off @ inverse)
    return parts.sum(axis=1), parts


def _with_distance(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs, s = _matrix(batch)
                d = np.zeros(len(s))
                for lang, (mean, inverse) in model.items():
                    d[langs == lang] = distances(s[langs == lang], mean, inverse)[0]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("s"), pa.array(d)], ["lang", "s", "d"])

    return run


def _sums(limits: dict):
    """Per language the count, sums and sums of products of the rows within the limit, as (lang, k, v)."""
    p = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {lang: np.zeros(1 + p + p * p) for lang in limits}
        for batch in batches:
            if batch.num_rows:
                langs, s = _matrix(batch)
                d = np.asarray(batch.column("d"))
                for lang, limit in limits.items():
                    own = s[(langs == lang) & (d <= limit)]
                    total[lang] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        for lang, v in total.items():
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, lang, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v)], ["lang", "k", "v"])

    return run


def fit_prose(stats: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each language the mean of prose and the inverse of its covariance, over all texts. stats: of ``_statistics``."""
    p = len(NAMES)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, s = _matrix(batch)
            yield pa.RecordBatch.from_arrays([pa.array(langs), *(pa.array(s[:, k]) for k in range(p))], ["lang", *NAMES])

    columns = stats.select("lang", "s").mapInArrow(opened, "lang INT, " + ", ".join(f"{n} DOUBLE" for n in NAMES))
    quartiles = columns.groupBy("lang").agg(*(F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in NAMES)).collect()
    model = {}
    for r in quartiles:
        q = np.array([r[n] for n in NAMES])
        model[r.lang] = (q[:, 1], np.diag(1 / (((q[:, 2] - q[:, 0]) / 1.35) ** 2 + FLOOR**2)))
    for _ in range(STEPS):
        scored = stats.select("lang", "s").mapInArrow(_with_distance(model), "lang INT, s BINARY, d DOUBLE")
        limits = {r.lang: r.q for r in scored.groupBy("lang").agg(F.percentile_approx("d", KEPT, 1000).alias("q")).collect()}
        if not limits:
            break
        summed = scored.mapInArrow(_sums(limits), "lang INT, k INT, v DOUBLE").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
        for lang in limits:
            v = np.zeros(1 + p + p * p)
            for r in summed:
                if r.lang == lang:
                    v[r.k] = r.v
            n = max(1.0, v[0])
            mean = v[1 : 1 + p] / n
            cov = v[1 + p :].reshape(p, p) / n - np.outer(mean, mean)
            trust = n / (n + 2 * p)
            model[lang] = (mean, np.linalg.inv(trust * cov + np.diag(FLOOR**2)))
    return model


def _measured(model: dict, langs: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared distance, contributions, what the discriminant reads: signed contributions and distances from the mean)."""
    d, parts, off = np.zeros(len(s)), np.zeros_like(s), np.zeros_like(s)
    for lang, (mean, inverse) in model.items():
        own = langs == lang
        d[own], parts[own] = distances(s[own], mean, inverse)
        off[own] = (s[own] - mean) * np.sqrt(np.diag(inverse))
    read = np.hstack((parts * np.sign(off) / np.sqrt(1 + d)[:, None], np.clip(off, -20, 20), np.ones((len(s), 1))))
    return d, parts, read


def fit_kinds(stats: DataFrame, rows: DataFrame, model: dict, cut: float, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(coefficients of each kind, trust) of the discriminant. What is gathered is bounded by ``sample``."""

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _measured(model, *_matrix(batch))[0]
                yield batch.filter(pa.array(d > cut))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [larger_part(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("s"), pa.array(kinds, pa.string())], ["lang", "s", "kind"])

    chosen = stats.mapInArrow(beyond, _STATS).dropDuplicates(["id", "h"]).orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample)
    # at most ``sample`` rows, whatever the table holds
    found = rows.join(F.broadcast(chosen), ["id", "h"]).select("lang", "s", "text").mapInArrow(looked_up, "lang INT, s BINARY, kind STRING").toPandas()
    width = 2 * len(NAMES) + 1
    if not len(found):
        return np.zeros((width, len(KINDS))), 0.0
    s = np.frombuffer(b"".join(found["s"]), np.float32).reshape(len(found), len(NAMES)).astype(np.float64)
    read = _measured(model, found["lang"].to_numpy(), s)[2]
    wanted = (found["kind"].to_numpy()[:, None] == np.array(KINDS)).astype(float)
    weights = np.linalg.solve(read.T @ read + RIDGE * np.eye(width), read.T @ wanted)
    return weights, len(found) / (len(found) + HALF_TRUST)


def score_texts(table: DataFrame, id_col: str = "row_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Each text with ``lang``, ``distance``, ``outlier``, ``kind`` (NULL for prose), ``looked_up`` (whether its parts decided),
    its statistics and their contributions."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    stats = materialize(spread(rows).mapInArrow(_statistics, _STATS), "stats")
    model = fit_prose(stats)
    weights, trust = fit_kinds(stats, rows, model, cut)
    p = len(NAMES)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, s = _matrix(batch)
            d, parts, read = _measured(model, langs, s)
            scores = read @ weights
            ordered = np.sort(scores, axis=1)
            open_ = (d > cut) & ((ordered[:, -1] - ordered[:, -2]) * trust < MARGIN)
            best = scores.argmax(axis=1)
            kinds = [KINDS[k] if far and k and not o else None for k, far, o in zip(best, d > cut, open_)]
            lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), p).cast(pa.list_(pa.float64())) for x in (s, parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array([LANGUAGES[k] for k in langs]), pa.array(d), pa.array(d > cut), pa.array(kinds, pa.string()), pa.array(open_), *lists],
                ["id", "h", "lang", "distance", "outlier", "kind", "looked_up", "statistics", "contributions"],
            )

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                kinds = [None if (k := larger_part(t)) == "prose" else k for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(kinds, pa.string())], ["id", "h", "part"])

    kind = "id BIGINT, h BIGINT, lang STRING, distance DOUBLE, outlier BOOLEAN, kind STRING, looked_up BOOLEAN, statistics ARRAY<DOUBLE>, contributions ARRAY<DOUBLE>"
    found = stats.mapInArrow(decide, kind)
    between = materialize(found.where("looked_up").select("id", "h").distinct(), "between-kinds")
    parts = rows.join(between, ["id", "h"]).select("id", "h", "text").mapInArrow(looked_up, "id BIGINT, h BIGINT, part STRING").distinct()
    decided = found.where("NOT looked_up").unionByName(found.where("looked_up").join(parts, ["id", "h"]).withColumn("kind", F.col("part")).drop("part"))
    return decided.drop("h").withColumnRenamed("id", id_col)


def not_prose(table: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``kind``) of the texts whose larger part is a list, a table or junk."""
    return score_texts(table, id_col, text_col).where("kind IS NOT NULL").select(id_col, "kind").distinct()
