"""Missing or wrong document language labels (problem 3).

Kneser-Ney character models (see `charmodel`) score every word in every language; a Viterbi pass with a price for
each change of language cuts a text into segments. A segment gets the language of the lowest length-normalised
cross-entropy, with a confidence calibrated on held-out texts, and is rejected where even that is too high.

The models are fitted on a bounded sample of labelled rows (`TRAIN_ROWS`, `TRAIN_CHARS`); everything else covers all
rows and whole texts. Labels are noisy, so the sample is relabelled by its own models and fitted again.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.session import spread

from . import charmodel
from .charmodel import SPACE, WALL, CharModels

#: Labelled rows in the training sample, and characters of each language that a model is fitted on.
TRAIN_ROWS, TRAIN_CHARS, ROUNDS = 24_000, 120_000, 3
#: What a change of language costs, in nats: more than a borrowed word gains, less than a sentence.
SWITCH = 12.0
#: Letters below which a text is never a case; letters and words below which a stretch is no segment of its own.
MIN_LETTERS, MIN_SEGMENT_LETTERS, MIN_SEGMENT_WORDS = 20, 10, 2
#: Code points of scripts written without spaces (South-East Asian and Tibetan, kana, Han), where a word is no measure.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF))
#: Calibration: words of the pieces that held-out texts are cut to, characters that bound the length bands, the part of texts in a foreign
#: language that may be accepted, the part of texts in a known one that may be rejected (it goes first), and temperatures tried.
PIECES, BANDS, ACCEPTED, REJECTED, HEATS = (2, 4, 8, 16), (24, 48, 96), 0.05, 0.001, tuple(2.0 ** (k / 2) for k in range(-12, 13))
#: Characters scored at once.
CHUNK = 300_000
#: Three-letter codes of the supported languages.
LONG_CODES = {
    "deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "hin": "hi", "ita": "it", "jpn": "ja",
    "nld": "nl", "dut": "nl", "pol": "pl", "por": "pt", "rus": "ru", "swe": "sv", "tur": "tr",
}
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.\w+|\b[ru]/\w+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def plain_code(column: str) -> Column:
    """A language code in two letters and lower case; other spellings come out as they are, lower-cased."""
    bare = F.split(F.regexp_replace(F.lower(F.trim(column)), "_", "-"), "-").getItem(0)
    spelled = F.create_map(*(F.lit(x) for pair in LONG_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(spelled, bare), bare)


def clean(text: str) -> str:
    """Links, addresses and invisible characters set aside; composed characters."""
    if "&" in text:
        text = html.unescape(text)
    if "://" in text or "www." in text or "@" in text or "r/" in text or "u/" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    return text.replace("\x01", " ")


@dataclass
class Words:
    """The words of several texts: text number, scores by language, letters, characters."""

    doc: np.ndarray
    score: np.ndarray
    letters: np.ndarray
    chars: np.ndarray
    #: Words of scripts written without spaces.
    unspaced: np.ndarray | None = None


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)]))
    return _LETTER[0]


def words_of(models: CharModels, texts: list[str]) -> Words:
    """Scores of the words of cleaned texts. Texts do not touch each other: walls lie between them."""
    wall = "\x01" * (charmodel.ORDER - 1)
    joined = "".join(f"{wall} {t} " for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + charmodel.ORDER + 1 for t in texts])
    inside = cps < 0x10000
    c = np.where(inside, charmodel.letter_table()[np.where(inside, cps, 0)], 0).astype(np.uint32)
    letter = inside & _is_letter()[np.where(inside, cps, 0)]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    c, doc, letter = c[keep], doc[keep], letter[keep]
    before = np.concatenate([[WALL], c[:-1]])
    starts = np.nonzero((c > WALL) & (before <= WALL))[0]
    n_lang = len(models.languages)
    if not len(starts):
        return Words(np.zeros(0, int), np.zeros((0, n_lang), np.float32), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
    counted = (c != WALL) & ~((c == SPACE) & (before == WALL))
    ends = np.append(starts[1:], len(c))
    score = np.empty((len(starts), n_lang), dtype=np.float32)
    a = 0
    while a < len(starts):  # windows of whole words, each with the characters before it as context
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, side="right")))
        lo, hi = starts[a], ends[b - 1]
        lead = min(charmodel.ORDER, lo)
        rows = models.score(c[lo - lead : hi])[lead:]
        rows[~counted[lo:hi]] = 0
        score[a:b] = np.add.reduceat(rows, starts[a:b] - lo, axis=0)
        a = b
    opens = c[starts].astype(np.int64) - 2
    unspaced = np.logical_or.reduce([(opens >= lo) & (opens <= hi) for lo, hi in UNSPACED])
    return Words(doc[starts], score, np.add.reduceat(letter.astype(np.int64), starts), np.add.reduceat(counted.astype(np.int64), starts), unspaced)


def best_path(w: Words, n_docs: int, price: float = SWITCH) -> np.ndarray:
    """The language number of each word on the best path of its text. Runs over word positions, all texts at once."""
    n, n_lang = w.score.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    size = np.bincount(w.doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    by_size = np.argsort(-size, kind="stable")
    came = np.zeros((n, n_lang), dtype=np.int8)  # the language of the word before, if this one has the column's
    total = np.zeros((n_docs, n_lang), dtype=np.float64)
    longest = int(size.max())
    alive_at = np.searchsorted(-size[by_size], -np.arange(longest), side="left")
    languages = np.arange(n_lang, dtype=np.int8)
    for step in range(longest):
        active = by_size[: alive_at[step]]
        at = first[active] + step
        t = total[active]
        if step:
            top = t.argmax(1)
            changed = t[np.arange(len(active)), top] - price
            stay = t >= changed[:, None]
            came[at] = np.where(stay, languages[None, :], top[:, None].astype(np.int8))
            t = np.where(stay, t, changed[:, None])
        total[active] = t + w.score[at]
    out = np.zeros(n, dtype=np.int64)
    now = total.argmax(1)
    for step in range(longest - 1, -1, -1):
        active = by_size[: alive_at[step]]
        at = first[active] + step
        out[at] = now[active]
        now[active] = came[at, now[active]]
    return out


def segments(models: CharModels, texts: list[str], temperature: float = 1.0) -> pd.DataFrame:
    """doc, segment_no, language_code, confidence, letters (of the whole text) for cleaned `texts`.

    A stretch of fewer than `MIN_SEGMENT_WORDS` words or `MIN_SEGMENT_LETTERS` letters is no segment: it goes to the
    stretch before it, or to the first real one. A text without letters gives no row; a rejected segment has the language 'und' and confidence 0.
    """
    w = words_of(models, texts)
    n_docs = len(texts)
    columns = ["doc", "segment_no", "language_code", "confidence", "letters"]
    if not len(w.doc):
        return pd.DataFrame({c: [] for c in columns})
    lang = best_path(w, n_docs)

    def runs(lang: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.nonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (doc[1:] != doc[:-1])]))[0]

    begin = runs(lang, w.doc)
    doc, code = w.doc[begin], lang[begin]
    score, letters, chars = (np.add.reduceat(x, begin, axis=0) for x in (w.score.astype(np.float64), w.letters, w.chars))
    n_words, unspaced = np.diff(np.append(begin, len(w.doc))), np.maximum.reduceat(w.unspaced, begin)
    total = np.bincount(w.doc, weights=w.letters, minlength=n_docs)
    real = (letters >= MIN_SEGMENT_LETTERS) & ((n_words >= MIN_SEGMENT_WORDS) | unspaced)
    has_real = np.bincount(doc, weights=real, minlength=n_docs) > 0
    # A text without a real stretch is one segment as a whole; elsewhere small stretches join the one before (or after).
    whole = ~has_real[doc]
    group = np.zeros(len(doc), dtype=np.int64)
    opens = (real & ~whole) | (np.concatenate([[True], doc[1:] != doc[:-1]]) & whole)
    group = np.cumsum(opens) - 1
    first_of_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    leading = first_of_doc & ~opens
    if leading.any():  # small stretches at the start go to the first real one of their text
        run_doc = np.where(opens, doc, -1)
        nxt = np.full(len(doc), -1)
        last = -1
        for i in range(len(doc) - 1, -1, -1):
            if run_doc[i] >= 0:
                last = group[i]
            nxt[i] = last
        started = np.zeros(len(doc), dtype=bool)
        seen_doc = -1
        for i in range(len(doc)):
            if opens[i]:
                seen_doc = doc[i]
            started[i] = seen_doc == doc[i]
        group = np.where(started, group, nxt)
    order = np.argsort(group, kind="stable")
    cut = np.nonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))[0]
    score, chars = np.add.reduceat(score[order], cut, axis=0), np.add.reduceat(chars[order], cut)
    lead = np.array([x[opens[x]][0] if opens[x].any() else x[0] for x in np.split(order, cut[1:])])
    doc, code = doc[lead], np.where(whole[lead], score.argmax(1), code[lead])
    # Neighbours that turned out to be of one language are one segment.
    cut = runs(code, doc)
    score, chars, doc, code = np.add.reduceat(score, cut, axis=0), np.add.reduceat(chars, cut), doc[cut], code[cut]
    best = score[np.arange(len(code)), code]
    odds = np.exp(np.clip((score - best[:, None]) / (temperature * np.sqrt(np.maximum(chars, 1)))[:, None], -50, 50)).sum(1)
    unknown = np.zeros(len(code), dtype=bool)
    if models.reject is not None:
        unknown = -best / np.maximum(chars, 1) > models.reject[np.searchsorted(BANDS, chars, side="right"), code]
    names = np.array(models.languages, dtype=object)[code]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
    return pd.DataFrame(
        {"doc": doc, "segment_no": number, "language_code": np.where(unknown, "und", names), "confidence": np.where(unknown, 0.0, 1 / odds), "letters": total[doc].astype(np.int64)}
    )


def fit(texts: list[str], labels: list[str], languages: list[str]) -> tuple[CharModels, float]:
    """Models from noisily labelled texts, and the temperature of the confidence.

    Every tenth text is held out. The others are relabelled in halves, each by the models of the other half (only texts
    that come out as a single segment stay), and fitted again. The held-out texts set the limits of rejection and the temperature.
    """
    number = {x: i for i, x in enumerate(languages)}
    cleaned = [clean(t) for t in texts]
    chosen, room = [], dict.fromkeys(languages, TRAIN_CHARS)
    held: list[tuple[str, str]] = []
    for k, (t, label) in enumerate(zip(cleaned, labels)):
        if k % 10 == 9:
            held.append((t, label))
        elif room[label] > 0:
            chosen.append((t, label))
            room[label] -= len(t)
    own = [t for t, _ in chosen]
    now: list[int | None] = [number[label] for _, label in chosen]
    prepared = [charmodel.prepare(t) for t in own]

    def fitted(members: range) -> CharModels:
        by_language: list[list[np.ndarray]] = [[] for _ in languages]
        for k in members:
            if now[k] is not None:
                by_language[now[k]].append(prepared[k])
        return charmodel.train(by_language, languages)

    halves = [range(0, len(own), 2), range(1, len(own), 2)]
    for _ in range(ROUNDS):
        # Each half is relabelled by the models of the other: models that were fitted on a wrong label would keep it.
        new: list[int | None] = [None] * len(own)
        for mine, other in (halves, halves[::-1]):
            found = segments(fitted(other), [own[k] for k in mine])
            alone = found[found["doc"].map(found["doc"].value_counts()) == 1]
            for d, code, letters in zip(alone["doc"], alone["language_code"], alone["letters"]):
                if letters >= MIN_LETTERS:
                    new[mine[int(d)]] = number[code]
        now = new
    models = fitted(range(len(own)))
    return models, calibrate(models, [t for t, _ in held], np.array([number[x] for _, x in held], dtype=int))


def calibrate(models: CharModels, texts: list[str], truth: np.ndarray) -> float:
    """Sets the limits of rejection from held-out texts, and returns the temperature of the confidence.

    Only texts that come out whole in the language of their label count: labels are noisy. They are cut to pieces of
    several lengths. What a foreign language looks like is known from the same pieces, scored without the model of
    their own language. A limit lies as far above the median cross-entropy of its language as lets `ACCEPTED` of the
    foreign pieces of a length band pass, but never so low that more than `REJECTED` of the band's own pieces fail.
    The temperature has the least cross-entropy of the pieces' languages, where it is not at the end of `HEATS`.
    """
    w = words_of(models, texts)
    if not len(w.doc):
        return 1.0
    path = best_path(w, len(texts))
    n = np.bincount(w.doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    same = np.bincount(w.doc, weights=path == truth[w.doc], minlength=len(texts)) == n
    letters = np.bincount(w.doc, weights=w.letters, minlength=len(texts))
    whole = np.nonzero(same & (n > 0) & (letters >= MIN_LETTERS))[0]
    if not len(whole):
        return 1.0
    score, chars = (np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x.astype(np.float64), axis=0)]) for x in (w.score, w.chars))
    ends = np.concatenate([first[whole] + np.minimum(n[whole], k) for k in (*PIECES, int(n.max()))])
    begins, own = np.tile(first[whole], len(PIECES) + 1), np.tile(truth[whole], len(PIECES) + 1)
    total, size = score[ends] - score[begins], np.maximum(chars[ends] - chars[begins], 1)
    at = np.arange(len(own))
    cost = -total / size[:, None]
    middle = np.array([np.median(cost[own == j, j]) if (own == j).any() else np.nan for j in range(len(models.languages))])
    middle = np.where(np.isnan(middle), np.nanmedian(middle), middle)
    without = cost.copy()
    without[at, own] = np.inf
    taken = without.argmin(1)
    mine, foreign = cost[at, own] - middle[own], without[at, taken] - middle[taken]
    band = np.searchsorted(BANDS, size, side="right")
    models.reject = np.empty((len(BANDS) + 1, len(models.languages)))
    for b in range(len(BANDS) + 1):
        here = band == b if (band == b).sum() >= 50 else np.ones(len(band), dtype=bool)
        models.reject[b] = middle + max(np.quantile(foreign[here], ACCEPTED), np.quantile(mine[here], 1 - REJECTED))
    # Single words join the pieces here: longer ones are hardly ever mistaken, and would call for no doubt at all.
    lone = np.nonzero(same[w.doc] & (w.letters > 0))[0]
    total, size, own = np.concatenate([total, w.score[lone]]), np.concatenate([size, np.maximum(w.chars[lone], 1)]), np.concatenate([own, truth[w.doc[lone]]])
    logits = (total - total.max(1, keepdims=True)) / np.sqrt(size)[:, None]
    chosen = np.take_along_axis(logits, own[:, None], 1)[:, 0]
    loss = {heat: float((np.log(np.exp(logits / heat).sum(1)) - chosen / heat).mean()) for heat in HEATS}
    return min(loss, key=loss.get)


def training_sample(comments: DataFrame, supported: list[str], rows: int = TRAIN_ROWS) -> tuple[list[str], list[str]]:
    """At most about `rows` labelled texts, the same ones on every run: those of the smallest hashed ids."""
    labelled = comments.where("comment_body_text is not null").select(
        "comment_id", plain_code("weighted_language_code").alias("code"), plain_code("top1_language_code").alias("top"), F.col("comment_body_text").alias("text")
    )
    labelled = labelled.where(F.col("code").isin(supported) & (F.col("code") == F.col("top")))
    available = comments.count()
    if available > rows:
        part = 1 << 20
        labelled = labelled.where(F.pmod(F.xxhash64("comment_id"), F.lit(part)) < F.lit(part * rows // available))
    got = labelled.select("comment_id", "code", "text").distinct().toPandas().sort_values("comment_id")
    return list(got["text"]), list(got["code"])


def language_segments(comments: DataFrame, lookup: DataFrame) -> DataFrame:
    """Per comment and segment: `comment_id`, `segment_no`, `language_code`, `confidence`, `is_case`.

    A comment is a case when its code is missing or of another language, its name is of another language, or it has
    segments in several languages. Comments with fewer than `MIN_LETTERS` letters are never cases; null and empty
    texts and texts without letters give no row. Repeats of a comment with the same text and labels come out once.
    """
    names = [(r.language_code, r.language_name, r.supported) for r in lookup.select("language_code", "language_name", "supported").collect()]
    supported = sorted(code for code, _, ok in names if ok)
    by_name = {n.lower(): c.lower() for c, n, _ in names if n and c and c.lower() not in ("unprocessed", "und")}
    texts, labels = training_sample(comments, supported)
    models, temperature = fit(texts, labels, supported)
    shared = comments.sparkSession.sparkContext.broadcast((models, temperature))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, heat = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                found = segments(m, [clean(t) for t in part["text"]], heat)
                if not len(found):
                    continue
                rows = part.iloc[found["doc"].to_numpy().astype(int)].reset_index(drop=True)
                many = found.groupby("doc")["segment_no"].transform("size") > 1
                code = found["language_code"].reset_index(drop=True)
                named = rows["name"].map(lambda n: by_name.get(n.strip().lower()) if isinstance(n, str) else None)
                wrong = many | (rows["code"].fillna("") != code) | (named.notna() & (named != code))
                none = (code == "und").groupby(found["doc"]).transform("all")
                case = wrong & (found["letters"] >= MIN_LETTERS) & ~none
                yield pd.DataFrame(
                    {"comment_id": rows["comment_id"], "segment_no": found["segment_no"].astype("int32"), "language_code": code, "confidence": found["confidence"], "is_case": case}
                )

    # Repeats are neighbours of nothing, so they are folded after the models have run, when rows are small.
    source = comments.where("comment_body_text is not null").select(
        "comment_id", plain_code("weighted_language_code").alias("code"), F.col("language_name").alias("name"), F.col("comment_body_text").alias("text")
    )
    found = spread(source).mapInPandas(run, "comment_id string, segment_no int, language_code string, confidence double, is_case boolean")
    return found.groupBy("comment_id", "segment_no", "language_code").agg(F.max("confidence").alias("confidence"), F.max("is_case").alias("is_case"))


def relabelled_segments(comments: DataFrame, lookup: DataFrame) -> DataFrame:
    """The segments of the comments whose label is missing or wrong, or that mix languages."""
    return language_segments(comments, lookup).where("is_case and language_code <> 'und'").select("comment_id", "segment_no", "language_code")
