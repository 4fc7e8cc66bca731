"""Statistics of texts, computed for a whole Arrow batch at once on code points."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from lodeflow.operators.batches import code_points, mix64

#: Frequent function words and signs of natural prose (fixed values; standard closed-class words).
COMMON_EN = (
    "the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which one "
    "you were all her she there would their we him been has when who will no more if out so up said what its about than "
    "into them can only other time new some could these two may first then do any like my now over such our man me even "
    "most made after also did many off before must through back years where much your way well down should because each "
    "just those how too little state good very make world still own see men work long here get both between life being "
    "under never day same another know while last might us great old year come since against go came right used take three"
)
COMMON_ZH = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运"
_HAN, _LATIN, _LETTER, _DIGIT, _SPACE, _LINE, _END, _COMMA, _PAIR, _CELL, _DOT, _SLASH, _OTHER = range(13)

NAMES = (
    "log_chars", "mean_token", "symbols", "punctuation", "digits", "lines_ended", "common", "long_units", "log_line",
    "cells", "entries", "distinct_units", "distinct_tokens", "vowels", "strange", "codes", "entropy", "largest_sign",
)


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            table[i] = _LATIN if i < 0x80 else _HAN if 0x3400 <= i <= 0x9FFF or 0x20000 <= i < 0x32000 else _LETTER
        elif kind[0] == "N":
            table[i] = _DIGIT
        elif kind in ("Zs", "Cf", "Cc"):
            table[i] = _SPACE
        elif kind in ("Ps", "Pe", "Pi", "Pf") or c in "\"'":
            table[i] = _PAIR
    for chars, kind in (("\n\r\x85\u2028\u2029", _LINE), ("。！？!?…", _END), ("，,、;；:：", _COMMA), ("|¦\t", _CELL), (".．", _DOT), ("/", _SLASH)):
        for c in chars:
            table[ord(c)] = kind
    return table


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    common = np.zeros(sys.maxunicode + 1, bool)
    common[[ord(c) for c in COMMON_ZH]] = True
    vowels = np.zeros(sys.maxunicode + 1, bool)
    vowels[[ord(c) for c in "aeiouAEIOU"]] = True
    words = sorted(set(COMMON_EN.split()))
    points, offsets = code_points(words)
    return common, vowels, np.sort(_run_hashes(points, offsets[:-1], np.diff(offsets)))


def _run_hashes(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = mix64((points[at].astype(np.uint64) << np.uint64(24)) | place.astype(np.uint64))
    return np.add.reduceat(mixed, np.cumsum(sizes) - sizes)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of different values of each text."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))) if len(d) else np.zeros(0, bool)
    return np.bincount(d[new], minlength=n).astype(float)


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of NAMES per text, share of Chinese among its letters, number of its visible characters)."""
    n = len(texts)
    # a line break in front of each text keeps runs from crossing texts
    points, offsets = code_points(["\n" + t for t in texts])
    kinds = _classes()[points]
    common, vowel, words = _tables()
    doc = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(doc * 13 + kinds, minlength=n * 13).reshape(n, 13).astype(float)
    visible = count.sum(1) - count[:, _SPACE] - count[:, _LINE] - np.bincount(doc[points == 9], minlength=n)
    letters = count[:, _HAN] + count[:, _LATIN] + count[:, _LETTER]
    chinese = _share(count[:, _HAN], letters)
    before, after = np.concatenate(([_LINE], kinds[:-1])), np.concatenate((kinds[1:], [_LINE]))

    # tokens: runs of letters and digits
    is_word = kinds <= _DIGIT
    start, size = _runs(is_word)
    own = doc[start]
    lower = np.where((points >= 65) & (points <= 90), points + 32, points)
    hashes = _run_hashes(lower, start, size)
    tokens = np.bincount(own, minlength=n).astype(float)
    mean_token = _share(np.bincount(own, size, n), tokens)
    distinct_tokens = _share(_distinct(own, hashes, n), tokens)
    has_digit, has_letter = (np.add.reduceat(x.astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool) for x in ((kinds == _DIGIT), (kinds == _LATIN)))
    ends = np.cumsum(np.concatenate(([0], kinds == _DIGIT)))
    digits_in = ends[start + size] - ends[start]
    ends = np.cumsum(np.concatenate(([0], kinds == _LATIN)))
    latin_in = ends[start + size] - ends[start]
    code = ((digits_in > 0) & (latin_in > 0)) | (latin_in > 18)
    codes = _share(np.bincount(own[code], size[code], n), visible)
    latin_words = np.bincount(own[latin_in == size], minlength=n).astype(float)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    common_words = np.bincount(own[(words[at] == hashes) & (latin_in == size)], minlength=n)
    common_signs = np.bincount(doc[common[points]], minlength=n)
    common_share = np.where(chinese >= 0.3, _share(common_signs, count[:, _HAN]), _share(common_words, latin_words))

    # units: what stands between marks, line ends, cells
    point_ends = (kinds == _DOT) & ~((before == _DIGIT) & (after == _DIGIT))
    wide = (kinds == _SPACE) & (before == _SPACE)
    mark = (kinds >= _LINE) & (kinds <= _COMMA) | (kinds == _CELL) | point_ends | wide | (kinds == _SLASH) | (points == 60) | (points == 62)
    ustart, usize = _runs(~mark)
    uown = doc[ustart]
    sums = {}
    token_first = np.zeros(len(points), np.int64)
    token_first[start[latin_in > 0]] = 1
    for name, x in (("han", kinds == _HAN), ("words", token_first), ("letters", kinds <= _LETTER)):
        c = np.concatenate(([0], np.cumsum(x)))
        sums[name] = c[ustart + usize] - c[ustart]
    real = sums["letters"] > 0
    long_unit = (sums["han"] >= 8) | (sums["words"] >= 5)
    long_units = _share(np.bincount(uown[long_unit], sums["letters"][long_unit], n), np.bincount(uown, sums["letters"], n))
    entries = _share(np.bincount(uown[real & ~long_unit], minlength=n), np.bincount(uown[real], minlength=n))
    only = np.where(kinds <= _LETTER, mix64(lower.astype(np.uint64)), np.uint64(0))
    unit_hash = np.add.reduceat(only, ustart) if len(ustart) else np.zeros(0, np.uint64)
    units = np.bincount(uown[real], minlength=n).astype(float)
    distinct_units = np.where(units > 0, _share(_distinct(uown[real], unit_hash[real], n), units), 1.0)

    # lines
    lstart, lsize = _runs(kinds != _LINE)
    lown = doc[lstart]
    seen = np.concatenate(([0], np.cumsum(kinds != _SPACE)))
    full = seen[lstart + lsize] - seen[lstart] > 0
    lstart, lsize, lown = lstart[full], lsize[full], lown[full]
    # the last visible sign of a line, closing marks aside
    position = np.where((kinds != _SPACE) & (kinds != _PAIR), np.arange(len(kinds)), 0)
    last = np.maximum.accumulate(position)[lstart + lsize - 1] if len(lstart) else lstart
    ended = np.isin(kinds[last], (_END, _DOT)) | (kinds[last] == _END)
    lines = np.bincount(lown, minlength=n).astype(float)
    lines_ended = _share(np.bincount(lown[ended], minlength=n), lines)

    cells = np.bincount(doc[(kinds == _CELL) | wide & (after != _SPACE) & (after != _LINE) | (points == 60)], minlength=n)
    bucket = (mix64(lower.astype(np.uint64)) >> np.uint64(56)).astype(np.int64)
    shown = (kinds != _SPACE) & (kinds != _LINE)
    hist = np.bincount(doc[shown] * 256 + bucket[shown], minlength=n * 256).reshape(n, 256)
    p = _share(hist.ravel().astype(float), np.repeat(visible, 256)).reshape(n, 256)
    entropy = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1)
    vowels = np.where(count[:, _LATIN] >= 20, _share(np.bincount(doc[vowel[points]], minlength=n), count[:, _LATIN]), 0.38)
    out = np.stack([
        np.log1p(visible), np.minimum(mean_token, 60), _share(count[:, _OTHER], visible),
        _share(count[:, _END] + count[:, _COMMA] + count[:, _PAIR] + count[:, _DOT], visible), _share(count[:, _DIGIT], visible), lines_ended,
        common_share, long_units, np.log1p(_share(visible, lines)), 100 * _share(cells, visible), entries, distinct_units,
        distinct_tokens, vowels, _share(count[:, _LETTER], letters), codes, entropy, p.max(axis=1),
    ], axis=1)
    return out, chinese, visible
