"""Defective answers in conversations and preference pairs.

Openings, the first clauses of every answer, are clustered by verified MinHash. A cluster that recurs across unrelated
prompts is a template. Templates that decline are told by known phrases to begin with, and then by their place: they stand
where those stand, beside the same apologies and offers. An answer is a refusal if a declining template is among its opening
clauses and templates of refusals make up at least half of it, however long it is; an answer that gives something else holds
clauses that don't recur, which soon outweigh them. Copies, other languages and answers that break off are told by checks on the answer and the
question before it, the nearest user message.

An answer has at most one defect, the first that holds of: empty, refusal, copy, language, truncated.

Defined results: NULL conversations, NULL messages, messages with tool calls, and rows without id are no cases. A NULL
content is empty; think tags and invisible characters don't count as content. An answer without a question before it can be
empty, a refusal or truncated. Rows sent twice come out once. Ties between rows that share id, field and turn but differ
in text come out with each of their defects. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm import canon
from lodeflow.operators.batches import mix64, spread
from lodeflow.operators.dedup import bucket_pairs
from lodeflow.operators.graph import components
from lodeflow.operators.skew import join_hot_split
from lodeflow.session import materialize

#: Clauses of an opening; prompts a template recurs across; signature length and rows of a band (recall 0.9998 at 0.8).
OPENING, PROMPTS, HASHES, ROWS = 4, 3, 36, 3
SIMILARITY = 0.8
#: Share of a refusal's letters and digits that may stand outside the templates of refusals.
REST = 0.5
#: Templates are learned from answers of at most so many clauses, and letters and digits (Chinese, other); what is learned
#: holds for answers of any length. A template of refusals has this share of its answers among those.
LEARNED, SHORT = (6, 48, 140), 0.9
#: Beside this many declining templates, in this share of its answers, a template is a companion of refusals; one that has
#: companions in this share, but no declining one, declines itself.
KINDS, BESIDE, PLACED = 2, 0.3, 0.2
#: Share of characters, in order, that a copy has in common with the question.
COPIED = 0.82

_THINK = regex.compile(r"<think>.*?(?:</think>|$)", regex.DOTALL | regex.IGNORECASE)
_TAGS = regex.compile(r"</?think>", regex.IGNORECASE)
_UNSEEN = regex.compile(r"[\p{Cf}\p{Cc}--[\n\r\t]]", regex.V1)
_CLAUSE = regex.compile(r"[\p{P}\p{S}\n\r--['’]]+", regex.V1)
_JOINS = regex.compile(r"^(?:but|though|although|and|so|yet|但是?|不过|可是|只是|所以)\s*(?=.)")
_HAN, _LATIN = regex.compile(r"\p{Han}"), regex.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_FENCE = regex.compile(r"```.*?(?:```|$)", regex.DOTALL)
_CODE_LINE = regex.compile(r"^(?:\s{2,}\S|.*[;{}]\s*$|\s*(?:def|for|while|if|let|const|var|return|import|print|SELECT|FROM|GROUP|console)\b.*[(=:].*$)")
_ITEM = regex.compile(r"^\s*(?:[-*•·]|[（(]?\d{1,3}[)）.、．])\s*\S")
_NUMBERED = regex.compile(r"^\s*(?:[-*•·]|[（(]?\d{1,3}[)）.、．])\s*\S*[^\d\s.=+-]")
_ENDED = regex.compile(r"[。！？.!?…~～;；][\p{Pe}\p{Pf}\p{Pi}\"'*_`\s]*$|[\p{Pe}\p{Pf}\"`]\s*$")
_LEAD = regex.compile(r"^[\s\p{P}\p{S}]*(?:问题|问|提问|用户|q|question|user)\s*[:：]\s*", regex.IGNORECASE)
_BREAKS_OFF = regex.compile(r"(?:例如|比如|譬如|包括|以及|并且|因为|所以|for example|such as|because|and|or|the)\s*[，,:：、]?\s*$", regex.IGNORECASE)

#: What a declining clause often says; templates that say it lead to those that say it otherwise.
_DECLINES = regex.compile(
    r"(?:无法|不能|不便|不方便|不会|没法|没办法|难以|不予|不宜)(?:就此|对此|为你|帮你|向你)?(?:回答|提供|讨论|协助|帮助|帮忙|帮|给出|谈论|谈|处理|满足|作答|透露|评论|继续|完成|给)"
    r"|超出.{0,8}(?:范围|能力)|恕.{0,4}(?:不能|无法|难)|拒绝"
    r"|(?:can'?t|cannot|can not|unable to|not able to|won'?t|will not|would rather not|'?d rather not|not going to|not comfortable|not in a position to|decline to|have to decline)\W+"
    r"(?:\w+\W+){0,3}(?:help|assist|answer|discuss|provide|go into|giv\w+|talk|share|comply|offer|comment|engage|do that|respond|continue|support)"
    r"|(?:outside|beyond|isn'?t something|not something|not a topic)\W+(?:\w+\W+){0,6}(?:discuss|scope|help|assist|answer|offer|able|can|may|talk)",
    regex.IGNORECASE,
)

#: A question that names the language of the answer.
_ASKS_EN = regex.compile(r"\bEnglish\b|英文|英语", regex.IGNORECASE)
_ASKS_ZH = regex.compile(r"\b(?:Chinese|Mandarin)\b|中文|汉语", regex.IGNORECASE)
_ASKS_REPEAT = regex.compile(r"重复|复述|照抄|抄写|原样|repeat|copy|word for word|verbatim|exactly", regex.IGNORECASE)
_ASKS_TRANSLATION = regex.compile(r"翻译|[英中汉日法德俄韩西]译|(?<!编)译(?:成|为|作|出|文|一下|\s*[:：])|(?:请|直|意|笔|口)译|translat|日语|日文|法语|法文|西班牙|德语|德文|韩语|俄语|\bFrench\b|\bSpanish\b|\bGerman\b|\bJapanese\b|\bKorean\b|\bRussian\b", regex.IGNORECASE)


def visible_answer(content: str | None) -> str:
    """The answer without think blocks and invisible characters."""
    return _UNSEEN.sub("", _TAGS.sub("", _THINK.sub("", content or ""))).strip()


def clauses(text: str) -> list[str]:
    """The clauses of a text, each in lower case, marks aside."""
    found = (" ".join(x.lower().split()) for x in _CLAUSE.split(text))
    return [c for c in (_JOINS.sub("", x) for x in found) if c]


_FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as at by from be this are have not or an they which one you had but what there we can out other were all your when up use how said each she do their if will way about many then them would so these her has two him see no could than been its who now did get come may",
    "fr": "le la les de des du et est une un que qui pour dans en sur pas plus par au aux ce cette il elle on nous vous sont avec mais ou où se sa son ses peut faut comme être",
    "es": "el la los las de del y es una un que para por en con no se su sus al lo como más pero o este esta son hay muy puede sigue aunque",
    "de": "der die das und ist nicht ein eine zu den dem mit auf für von im es sich auch als an werden aus er sie wir ich kann man oder aber wenn noch wie",
    "it": "il lo la gli le di del e è una un che per in con non si su al da come più ma sono questo questa può",
    "pt": "o a os as de do da e é uma um que para por em com não se seu sua ao como mais mas são este esta pode",
}
_WORDS = {k: set(v.split()) for k, v in _FUNCTION_WORDS.items()}
_SCRIPTS = {"ja": r"[\p{Hiragana}\p{Katakana}]", "ko": r"\p{Hangul}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "el": r"\p{Greek}", "he": r"\p{Hebrew}", "th": r"\p{Thai}", "hi": r"\p{Devanagari}"}
_SCRIPTS = {k: regex.compile(v) for k, v in _SCRIPTS.items()}
_ANY_WORD = regex.compile(r"\p{Latin}+")
_JSON_KEY = regex.compile(r"\"[A-Za-z_]+\"\s*:")


def language(text: str, least: float = 3) -> str | None:
    """The language of the larger part of the words, code and numbers aside; None if there are fewer than ``least``."""
    plain = "\n".join(x for x in _FENCE.sub(" ", text).splitlines() if not _CODE_LINE.match(x))
    plain = _JSON_KEY.sub(" ", plain)
    words = [w.lower() for w in _ANY_WORD.findall(plain)]
    amounts = {k: len(v.findall(plain)) / 2 for k, v in _SCRIPTS.items()}
    han = len(_HAN.findall(plain)) / 1.6
    if amounts["ja"] * 2 > 0.15 * (han * 1.6 + amounts["ja"] * 2):
        amounts["ja"] += han
    else:
        amounts["zh"] = han
    if words:
        shares = {k: sum(w in v for w in words) for k, v in _WORDS.items()}
        best = max(shares, key=lambda k: shares[k])
        latin = best if shares[best] > shares["en"] and shares[best] >= 0.15 * len(words) else "en"
        amounts[latin] = len(words)
    if sum(amounts.values()) < least:
        return None
    return max(amounts, key=lambda k: amounts[k])


def in_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of ``b`` in the bits of one number, whatever the lengths."""
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for c in a:
        if met := places.get(c):
            both = row & met
            row = (row + both | row - both) & whole
    return len(b) - row.bit_count()


def _alike(a: str, b: str, least: float = COPIED) -> float:
    """Share of characters in common, in order, of both; 0 where lengths or characters rule out ``least``."""
    total = len(a) + len(b)
    if not a or not b or 2 * min(len(a), len(b)) < least * total:
        return 0.0
    if 2 * (Counter(a) & Counter(b)).total() < least * total:
        return 0.0
    return 2 * in_common(a, b) / total


def is_copy(question: str, answer: str) -> bool:
    """Only says the question again, once or more often, nearly word for word."""
    q, a = canon.flat(question), canon.flat(_LEAD.sub("", answer))
    whole = _alike(q * max(1, round(len(a) / max(1, len(q)))), a)
    if whole < COPIED:
        return False
    asked = _ASKS_REPEAT.search(question)
    mark = asked and regex.search(r"[:：\n“\"「『]", question[asked.end() :])  # what is to be repeated follows; an ordinary question has no such part
    return not mark or _alike(canon.flat(question[asked.end() + mark.end() :]), a) < whole


def wrong_language(question: str, answer: str) -> bool:
    """Mostly in another language than the question, which didn't ask for it."""
    if _ASKS_REPEAT.search(question) and regex.search(r"[:：]", question):
        return False
    got = None if answer[:1] in "{[" and regex.match(r"^[\[{]\s*[\"{\[\d]", answer) else language(answer)
    if got is None:
        return False
    if _ASKS_EN.search(question) or _ASKS_ZH.search(question) or _ASKS_TRANSLATION.search(question):
        return False
    want = language(question, 1)
    return want is not None and want != got


def _open_brackets(text: str) -> bool:
    depth, quoted, before = 0, False, ""
    for c in text:
        if c == '"' and before != "\\":
            quoted = not quoted
        elif not quoted:
            depth += (c in "{[(") - (c in "}])")
        before = c
    return depth > 0 or quoted and depth > 0


def breaks_off(answer: str) -> bool:
    """Ends before it is finished. Numbers, short answers, lists and whole code need no full stop."""
    text = answer.strip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    lines = [x for x in text.splitlines() if x.strip()]
    last = lines[-1] if lines else ""
    if text[:1] in "{[" and regex.match(r"^[\[{]\s*[\"{\[\d]", text):
        return _open_brackets(text)
    if _CODE_LINE.match(last):
        return _open_brackets(text) or last.rstrip()[-1:] in "=+-*/%,.([{:" or False
    if regex.search(r"[，,、:：(（\[{“‘《—-]\s*$|[，,、:：][\p{Pf}\"]\s*$", last):
        return True
    if regex.search(r"\d\.$", last) and _HAN.search(last):
        return True  # at a decimal point
    if len(lines) > 1 and _NUMBERED.match(lines[-2]) and regex.fullmatch(r"\s*(?:[-*•·]|[（(]?\d{1,3}[)）.、．]?)\s*", last):
        return True  # at the mark of a further item
    if _ENDED.search(last):
        return False
    if len(lines) > 1 and _ITEM.match(last):
        return any(_ENDED.search(x) for x in lines[:-1] if _ITEM.match(x))
    if _BREAKS_OFF.search(last):
        return True
    sentence = regex.split(r"[。！？]|[.!?]\s", last)[-1]
    han, words = len(_HAN.findall(sentence)), len(_LATIN.findall(sentence))
    if len(text) != len(sentence.strip()) or regex.search(r"[，,；;]", text):
        return han + words > 0  # other sentences or clauses ended with marks, this one doesn't
    return han >= 12 or words >= 7


_FACTS = "id BIGINT, field STRING, turn INT, defect STRING, short BOOLEAN, clauses ARRAY<STRING>, q BIGINT"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("id", "field", "turn", "defect", "short", "clauses", "q")}
        for k in range(batch.num_rows):
            question: str | None = None
            for turn, m in enumerate(batch.column("messages")[k].as_py() or ()):
                if m is None:
                    continue
                if m["role"] == "user":
                    question = m["content"]
                elif m["role"] == "assistant" and not (m["tool_calls"] or "").strip():
                    answer = visible_answer(m["content"])
                    letters = len(canon.flat(answer))
                    defect, parts = None, []
                    if not letters:
                        defect = "empty"
                    else:
                        parts = clauses(answer)
                        if question and is_copy(question, answer):
                            defect = "copy"
                        elif question and wrong_language(question, answer):
                            defect = "language"
                        elif breaks_off(answer):
                            defect = "truncated"
                    short = len(parts) <= LEARNED[0] and letters <= LEARNED[1 if _HAN.search(answer) else 2]
                    values = (batch.column("id")[k].as_py(), batch.column("field")[k].as_py(), turn, defect, short, parts, int.from_bytes(_hash(canon.flat(question or "")), "little", signed=True))
                    for column, v in zip(out.values(), values):
                        column.append(v)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds)], list(out))


def _hash(text: str) -> bytes:
    from hashlib import blake2b

    return blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


@functools.cache
def _seeds() -> np.ndarray:
    return mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every piece of three characters of the flat texts; a shorter text is one piece, an empty one none."""
    points, offsets = canon.flatten(texts)
    lengths = np.diff(offsets)
    counts = np.where(lengths > 0, np.maximum(lengths - 2, 1), 0)
    own = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][own]
    padded = np.concatenate((points.astype(np.uint64) + np.uint64(1), np.zeros(2, np.uint64)))
    h = np.zeros(len(at), np.uint64)
    for k in range(3):
        h = (h << np.uint64(21)) | np.where(at + k < offsets[1:][own], padded[at + k], np.uint64(0))
    return mix64(h), own


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, prompts, band, key) of each clause; its text stays behind."""
    bands = HASHES // ROWS
    for batch in batches:
        h, own = _grams(batch.column("clause").to_pylist())
        kept, first = np.unique(own, return_index=True)
        least = np.empty((len(kept), HASHES), np.uint64)
        for k, seed in enumerate(_seeds()):
            least[:, k] = np.minimum.reduceat(mix64(h ^ seed), first) if len(kept) else 0
        least = least.reshape(len(kept), bands, ROWS)
        key = np.zeros((len(kept), bands), np.uint64)
        for r in range(ROWS):
            key = mix64(key + least[:, :, r])
        names, counts = (np.asarray(batch.column(c))[kept] for c in ("id", "prompts"))
        columns = (np.repeat(names, bands), np.repeat(counts, bands), np.tile(np.arange(bands, dtype=np.int32), len(kept)), key.view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "prompts", "band", "key"])


def similarities(one: list[str], two: list[str]) -> np.ndarray:
    """Share of pieces that each pair of texts has in common, of those in either; exact."""
    sides = []
    for texts in (one, two):
        h, own = _grams(texts)
        keys, first = np.unique(mix64(own.astype(np.uint64)) + h, return_index=True)  # the text is part of the key
        sides.append((keys, own[first]))
    keys, own = (np.concatenate(x) for x in zip(*sides))
    order = np.argsort(keys, kind="stable")
    twice = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    both = np.bincount(own[order][1:][twice], minlength=len(one))
    either = np.bincount(own, minlength=len(one)) - both
    return both / np.maximum(either, 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = similarities(batch.column("clause").to_pylist(), batch.column("head").to_pylist()) >= SIMILARITY - 1e-12
        yield batch.filter(pa.array(near))


def _declining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = pa.array([bool(_DECLINES.search(c)) for c in batch.column("clause").to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("clause", "template", "size", "short")), said], ["clause", "template", "size", "short", "declines"])


def templates(facts: DataFrame, prompts: int = PROMPTS) -> DataFrame:
    """(``clause``, ``template``, ``size``, ``short``, ``declines``): clauses of clusters that recur across prompts, with
    the number of answers and of short ones, and whether the clause says a known phrase.

    In each band's bucket a distinct clause meets the most frequent one and the one beside it; what is verified to be alike
    is linked, and linked clauses are one cluster, also over others between them. Clauses are counted by prompt with partial
    counts made before any shuffle, so a clause that a third of the answers share is one row from then on; no pairs within a
    bucket are made. Hot buckets are split.
    """
    said = F.when(F.col("short"), F.col("clauses")).otherwise(F.slice("clauses", 1, OPENING))
    opened = facts.where(F.size("clauses") > 0).select("q", F.col("short").cast("long").alias("short"), F.explode(said).alias("clause"))
    by_prompt = opened.groupBy("clause", "q").agg(F.count("*").alias("m"), F.sum("short").alias("s"))
    counted = by_prompt.groupBy("clause").agg(F.count("*").alias("prompts"), F.sum("m").alias("size"), F.sum("s").alias("short"))
    distinct = materialize(counted.withColumn("id", F.xxhash64("clause")), "clauses")
    banded = materialize(distinct.select("id", "clause", "prompts").mapInArrow(_bands, "id BIGINT, prompts BIGINT, band INT, key BIGINT"), "bands")
    heads = banded.groupBy("band", "key").agg(F.max(F.struct("prompts", "id")).alias("top"), F.count("*").alias("members")).where("members > 1")
    heads = materialize(heads.select("band", "key", F.col("top.id").alias("head"), "members"), "heads")
    met = join_hot_split(banded.select("id", "band", "key"), heads, ["band", "key"], "members", banded.count()).where("id <> head").select("id", "head")
    beside = bucket_pairs(banded.select("band", "key", "id").join(heads.select("band", "key"), ["band", "key"], "left_semi")).select(F.col("a").alias("head"), "id")
    pairs = met.unionByName(beside).select(F.least("id", "head").alias("id"), F.greatest("id", "head").alias("head")).distinct()
    texts = distinct.select("id", "clause")
    named = pairs.join(texts, "id").join(texts.select(F.col("id").alias("head"), F.col("clause").alias("head_clause")), "head").select("id", F.col("head").alias("other"), "clause", F.col("head_clause").alias("head"))
    near = materialize(named.mapInArrow(_verified, "id BIGINT, other BIGINT, clause STRING, head STRING").select("id", "other"), "alike")
    labels = components(near, "id", "other")
    members = materialize(distinct.join(labels, "id", "left").select("id", "clause", "prompts", "size", "short", F.coalesce("label", "id").alias("label")), "members")
    recurring = members.groupBy("label").agg(F.sum("prompts").alias("across"), F.max_by("clause", F.struct("prompts", "id")).alias("template")).where(F.col("across") >= prompts)
    return members.join(recurring, "label").select("clause", "template", "size", "short").mapInArrow(_declining, "clause STRING, template STRING, size BIGINT, short BIGINT, declines BOOLEAN")


def declining_clauses(facts: DataFrame, named: DataFrame) -> DataFrame:
    """(``clause``, ``size``): the clauses of templates that decline. named: of ``templates``.

    Templates that mostly say a known phrase come first. Those of short answers that often stand beside several of them
    are their companions: apologies, reasons, offers. A template of short answers that has companions beside it and no
    declining one takes the place of one, so it declines as well; this is repeated until nothing is added.
    """
    sized = named.groupBy("template").agg(F.sum("size").alias("size"), F.sum("short").alias("short"), F.sum(F.when(F.col("declines"), F.col("size")).otherwise(0)).alias("said"))
    closed = materialize(sized.where(F.col("short") >= F.lit(SHORT) * F.col("size")).select("template", "size", (2 * F.col("said") >= F.col("size")).alias("declines")), "closed-templates")
    held = named.join(closed.select("template"), "template", "left_semi").select("clause", "template", "size")
    key = ["id", "field", "turn", "q"]
    spoken = facts.where("short").select(*key, F.explode("clauses").alias("clause"))
    rows = join_hot_split(spoken, held, ["clause"], "size", facts.count()).select(*key, "template").distinct()
    answers_of = materialize(rows.groupBy(*key).agg(F.collect_set("template").alias("all")).groupBy("all").agg(F.count("*").alias("m")), "answer-forms")
    forms = materialize(answers_of.withColumn("form", F.xxhash64(F.array_sort("all"))).select("form", "m", F.explode("all").alias("template")), "forms")
    total = forms.groupBy("template").agg(F.sum("m").alias("total"))
    core = materialize(closed.where("declines").select("template"), "declining-templates")
    while True:
        holding = forms.join(core, "template", "left_semi").select("form", F.col("template").alias("core"))
        others = forms.join(core, "template", "left_anti")
        beside = others.join(holding, "form").groupBy("template", "form").agg(F.max("m").alias("m"), F.collect_set("core").alias("cores"))
        met = beside.groupBy("template").agg(F.sum("m").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("cores")))).alias("kinds"))
        met = materialize(met.join(total, "template"), "beside-declining")
        companions = met.where((F.col("kinds") >= KINDS) & (F.col("n") >= F.lit(BESIDE) * F.col("total"))).select("template")
        left = others.join(holding, "form", "left_anti")
        placed = left.join(left.join(companions, "template", "left_semi").select("form").distinct(), "form", "left_semi")
        placed = placed.join(met, "template", "left_anti").groupBy("template").agg(F.sum("m").alias("w")).join(total, "template")
        added = materialize(placed.where((F.col("w") >= 2) & (F.col("w") >= F.lit(PLACED) * F.col("total"))).select("template"), "also-declining")
        if added.isEmpty():
            break
        core = materialize(core.unionByName(added), "declining-templates")
    return named.join(core.withColumn("placed", F.lit(True)), "template", "left").where("declines OR placed").select("clause", "size")


def answers(table: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row of facts for each assistant answer of the fields."""
    parts = [table.select(F.col(id_col).cast("bigint").alias("id"), F.lit(f).alias("field"), F.col(f).alias("messages")) for f in fields]
    rows = functools.reduce(DataFrame.unionByName, parts).where("id IS NOT NULL AND messages IS NOT NULL")
    rows = rows.select("id", "field", F.transform("messages", lambda m: F.when(m.isNotNull(), F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls")))).alias("messages"))
    return spread(rows).mapInArrow(_facts, _FACTS)


def refusals(facts: DataFrame, declining: DataFrame) -> DataFrame:
    """(``id``, ``field``, ``turn``) of the answers that open with a declining clause and hold hardly anything but clauses
    that recur in such answers to several questions. declining: of ``declining_clauses``."""
    key, total = ["id", "field", "turn"], facts.count()
    opened = facts.select(*key, F.explode(F.slice("clauses", 1, OPENING)).alias("clause"))
    named = join_hot_split(opened, declining, ["clause"], "size", total).select(*key).distinct()
    spoken = facts.join(named, key, "left_semi").select(*key, "q", F.explode("clauses").alias("clause")).withColumn("letters", F.length(F.replace("clause", F.lit(" "), F.lit(""))))
    spoken = materialize(spoken, "declining-answers")
    across = spoken.groupBy("clause", "q").agg(F.count("*").alias("m")).groupBy("clause").agg(F.count("*").alias("prompts"), F.sum("m").alias("size"))
    known = materialize(across.where(F.col("prompts") >= PROMPTS).select("clause", "size").unionByName(declining).groupBy("clause").agg(F.max("size").alias("size")), "known-clauses")
    held = join_hot_split(spoken, known, ["clause"], "size", spoken.count()).groupBy(*key).agg(F.sum("letters").alias("held"))
    whole = spoken.groupBy(*key).agg(F.sum("letters").alias("letters"))
    return whole.join(held, key).where(F.col("letters") - F.col("held") <= REST * F.col("letters")).select(*key)


def defective_answers(sources: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(``record_id``, ``field``, ``turn``, ``defect``). sources: (table, id column, conversation columns)."""
    facts = materialize(functools.reduce(DataFrame.unionByName, (answers(*s) for s in sources)), "facts")
    declining = materialize(declining_clauses(facts, materialize(templates(facts), "templates")), "declining")
    found = refusals(facts, declining).withColumn("defect", F.lit("refusal"))
    others = facts.where("defect IS NOT NULL").select("id", "field", "turn", "defect")
    rank = F.array_position(F.array(*(F.lit(x) for x in ("empty", "refusal", "copy", "language", "truncated"))), F.col("defect"))
    best = others.unionByName(found).groupBy("id", "field", "turn").agg(F.min(F.struct(rank.alias("r"), F.col("defect").alias("defect"))).alias("d"))
    return best.select(F.col("id").alias("record_id"), "field", "turn", F.col("d.defect").alias("defect"))
