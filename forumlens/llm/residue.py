"""Template residue and error-page text (problem 8).

A regularised logistic regression over hashed word n-grams, unfilled-field, length and title features. It learns from
weak labels: response-status numbers in error wording, phrases of error pages, script demands and filler, and field
syntax that no prose uses. Documents that merely mention such things, or that the rules cannot tell, are left to the
model. Single sentences of plain documents are negatives too, so that a short text is not taken for a notice for being short. The training sample is bounded (`SAMPLE`); communities (hosts) are split, so the strength of the regularisation
and the threshold are chosen on hosts the model has not seen. Then every whole document is scored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.session import spread

#: Documents in the training sample, of which one in `PLAIN_PART` of the longer ones without any mention is kept, with some
#: of its sentences as harmless short texts (all up to `SHORT` characters are kept, as they are the ones that can be taken for a notice); hashed features, least letters of a case, strengths of regularisation tried, steps of a fit.
SAMPLE, PLAIN_PART, SHORT, DIMS, MIN_LETTERS, STRENGTHS, ROUNDS = 20_000, 5, 240, 1 << 18, 8, (1e-4, 1e-5, 1e-6), 120
#: Parts that the hosts are split into, one of which is held out.
HOST_PARTS = 5
#: Weak labels only, they do not enter the features: characters up to which wording makes a notice, a demand or filler, and characters
#: and words from which a text that mentions such things is taken for prose about them. In between the rules do not tell.
NOTICE_CHARS, DEMAND_CHARS, FILLER_CHARS, PROSE_CHARS, PROSE_WORDS = 600, 220, 120, 250, 40
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|~~~.*?(?:~~~|\Z)|<(?:code|pre)\b.*?</(?:code|pre)>", re.S | re.I)
_NAME = r"\s*([A-Za-z][\w. -]{0,38}?)\s*"
#: Field syntax of common template languages. The first group never occurs in prose.
STRONG = {
    "braces": re.compile(r"\{\{" + _NAME + r"\}\}"),
    "tag": re.compile(r"\{%" + _NAME + r"%\}"),
    "erb": re.compile(r"<%=?" + _NAME + r"%>"),
    "dollar": re.compile(r"\$\{" + _NAME + r"\}"),
    "hash": re.compile(r"#\{" + _NAME + r"\}"),
    "shell": re.compile(r"\$\(" + _NAME + r"\)"),
    "format": re.compile(r"%\(" + _NAME + r"\)[sd]"),
    "percent": re.compile(r"%([A-Z][A-Z_]{2,38})%"),
    "wiki": re.compile(r"\[\[" + _NAME + r"\]\]"),
    "at": re.compile(r"@@" + _NAME + r"@@"),
    "under": re.compile(r"__([A-Z][A-Z_]{1,38}?)__"),
    "enter": re.compile(r"\(\((?:enter|insert|your)\s+" + _NAME + r"\)\)", re.I),
    "insert": re.compile(r"\[(?:insert|enter|your)\s+" + _NAME + r"\]", re.I),
    "your": re.compile(r"<(?:your|enter|insert)\s+" + _NAME + r">", re.I),
    "marked": re.compile(r"<([A-Z][A-Z_]*?)_PLACEHOLDER>"),
}
WEAK = {"brace": re.compile(r"(?<![{$#\w%])\{" + _NAME + r"\}(?!\})"), "square": re.compile(r"(?<!\[)\[([A-Z][A-Z_]{2,38})\](?!\])")}
#: What every match of a style holds, to be looked for first.
_HINT = {
    "braces": "{{", "tag": "{%", "erb": "<%", "dollar": "${", "hash": "#{", "shell": "$(", "format": "%(", "percent": "%", "wiki": "[[", "at": "@@",
    "under": "__", "enter": "((", "insert": "[", "your": "<", "marked": "_PLACEHOLDER", "brace": "{", "square": "[",
}
#: Wording of error pages, of demands for scripts, and of filler. They are searched in lower-cased text.
_STATUS = re.compile(r"\b(?:error|status|code|fehler|erreur|erro|err)[ _:#-]{0,3}[45]\d\d\b|\b[45]\d\d[ :_-]{1,3}(?:error|not found|forbidden|bad|-)|\([45]\d\d\)|^\W{0,3}[45]\d\d\b", re.M)
_ERROR = re.compile(
    r"access denied|acceso denegado|accès refusé|acesso negado|zugriff verweigert|log in to continue|inicie sesión|too many requests|down for maintenance"
    r"|refused the connection|closed unexpectedly|threw an exception|over capacity|application error"
    r"|request id|no longer exists|could not be (?:found|located)|unavailable right now"
    r"|cannot be displayed|try again later|contact the site owner|unusual traffic|no se encuentra|introuvable|nicht gefunden"
    r"|checking your browser|moved or taken down|not available in your"
    r"|deleted or renamed|failed to load|nicht erreichbar|não encontrada|fora do ar|ne répond pas|no responde",
)
_SCRIPTS = re.compile(r"java ?script|\bjs\b|\bscripts\b|\bscripting\b|\bcookies\b")
_DEMAND = re.compile(
    r"\b(?:requires?|you must|must|need(?:s|ed)? to|please|to continue|until|disabled|to be off|switched off|not supported|blocked|we need|necesario|veuillez|bitte|ative|attiva|switch on|turn on|turn it on|activate|enable|allow)\b")
_FILLER = re.compile(
    r"lorem ipsum|\btodo:|text goes here|sample (?:post )?text|placeholder text|texto de ejemplo|texte à compléter|hier steht später|starts here|do not publish|to be decided|no content yet|replace before|under construction|(?:text|content) here\b")
_LATIN = re.compile(r"\b(?:lorem|ipsum|dolor|dolum|amet|consecta|consectetur)\b")
_MASH = re.compile(r"\b(?:foo|bar|baz|xxx+|asdf\w*|qwer\w*|test|blah|zzz+)\b")
_SELF = re.compile(r"\b(?:i|my|me|ich|mein\w*|je|mon|mes|mi|meu|minha)\b")
_SENTENCE = re.compile(r"[.!?\n。！？।]+")
_TITLE = re.compile(r"<title>(.*?)</title>", re.I | re.S)
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
#: Words and numbers; scripts without spaces by the character.
_TOKEN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_]+|\d+")


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIMS


class _Words(dict):
    """Word to bucket, remembered; forgotten altogether when it grows large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if w[0].isdigit():
            key = "status" if len(w) == 3 and w[0] in "45" else "#" * min(len(w), 5)
        else:
            key = w
        self[w] = value = _bucket("w:" + key)
        return value


_WORDS = _Words()


def outside_code(text: str) -> str:
    return _CODE.sub(" \n ", text) if "`" in text or "~~~" in text or "<" in text else text


def fields(text: str) -> list[tuple[str, str]]:
    """(style, name) of every unfilled field outside code; strong styles first."""
    found, rest = [], text
    for style, pattern in STRONG.items():
        if _HINT[style] in rest:
            hits = pattern.findall(rest)
            if hits:
                found += [(style, h) for h in hits]
                rest = pattern.sub(" ", rest)
    for style, pattern in WEAK.items():
        if _HINT[style] in rest:
            found += [(style, h) for h in pattern.findall(rest)]
    return [(s, n.lower().split(".")[-1].strip()) for s, n in found]


#: Weak labels besides 1 and 0: the rules cannot tell; only the names in weak field syntax can; 0 without any mention.
UNSURE, BY_NAME, PLAIN = -1, -2, -3


@dataclass
class Parts:
    """What the features and the weak label of a document are made from: no label rule enters the features."""

    low: str
    words: list[int]
    head: list[int]
    extra: list[int]
    names: list[tuple[str, str]]


def parts_of(text: str) -> Parts:
    body = outside_code(text)
    names = fields(body)
    title = _TITLE.search(body) if "<" in body else None
    plain = html.unescape(body) if "&" in body else body
    plain = (_TAGS.sub(" ", plain) if "<" in plain else plain).strip()
    low = plain.lower()
    first = (title.group(1) if title else plain.split("\n", 1)[0]).lower()
    words = [_WORDS[w] for w in _TOKEN.findall(low)]
    head = words[: len(_TOKEN.findall(first))] if not title else [_WORDS[w] for w in _TOKEN.findall(first)]
    extra = [f"length:{len(plain).bit_length()}"] + (["title"] if title else [])
    if names:
        extra += ["field:many" if len(names) > 1 else "field:one", *{f"name:{n}" for _, n in names}]
    return Parts(low, words, head, [_bucket("x:" + e) for e in extra], names)


@dataclass
class Batch:
    """Features of several documents: buckets and values end to end, and where each document starts."""

    ids: np.ndarray
    values: np.ndarray
    starts: np.ndarray


def featurise(parts: list[Parts]) -> Batch:
    """Word and word-pair buckets, the first line's (or title's) words, length, title and field features.

    Grams weigh 2 / sqrt(their number), title words 1 / sqrt(theirs), so long texts do not outweigh short ones.
    """
    n_words, n_head, n_extra = (np.array([len(x) for x in c], dtype=np.int64) for c in ([p.words for p in parts], [p.head for p in parts], [p.extra for p in parts]))
    flat = lambda lists: np.fromiter(chain.from_iterable(lists), dtype=np.int64)
    words, doc = flat(p.words for p in parts), np.repeat(np.arange(len(parts)), n_words)
    within = np.nonzero(doc[1:] == doc[:-1])[0] if len(doc) else np.zeros(0, int)
    pairs = (words[within] * 31 + words[within + 1] * 17 + 1) % DIMS
    grams = np.maximum(1, n_words + np.maximum(n_words - 1, 0))
    owner = np.concatenate([doc, doc[within], np.repeat(np.arange(len(parts)), n_head), np.repeat(np.arange(len(parts)), n_extra)])
    ids = np.concatenate([words, pairs, (flat(p.head for p in parts) * 13 + 5) % DIMS, flat(p.extra for p in parts)])
    weight = np.concatenate([(2 / np.sqrt(grams))[doc], (2 / np.sqrt(grams))[doc[within]], np.repeat(1 / np.sqrt(np.maximum(1, n_head)), n_head), np.ones(int(n_extra.sum()))])
    order = np.argsort(owner, kind="stable")
    size = np.bincount(owner, minlength=len(parts))
    return Batch(ids[order], weight[order].astype(np.float32), np.cumsum(size) - size)


def weak_label(p: Parts) -> int:
    """1, 0, or one of the three above, from field syntax, response status and phrases."""
    if any(s in STRONG for s, _ in p.names):
        return 1
    low, n_words = p.low, len(p.words)
    error, script, filler, status = _ERROR.findall(low), _SCRIPTS.search(low), _FILLER.search(low), _STATUS.search(low)
    latin, spoken = len(_LATIN.findall(low)), bool(_SELF.search(low))
    if latin >= max(3, 0.1 * n_words):
        return 1
    if n_words >= 3 and len(_MASH.findall(low)) >= 0.7 * n_words:
        return 1
    if not spoken and len(low) <= NOTICE_CHARS and (status and error or len(error) >= 2 or script and _DEMAND.search(low) and len(low) <= DEMAND_CHARS):
        return 1
    if filler and len(low) <= FILLER_CHARS and not spoken:
        return 1
    if p.names:
        return BY_NAME
    if not (error or script or filler or status or latin):
        return PLAIN
    return 0 if len(low) > PROSE_CHARS and n_words > PROSE_WORDS else UNSURE


def snippets(text: str, most: int) -> list[str]:
    """The first words of sentences of a text without any mention: examples of harmless texts of all short lengths."""
    found = [x.split() for x in _SENTENCE.split(text) if len(x.strip()) >= 4]
    lengths = (2 + (zlib.crc32(text[:64].encode("utf-8", "surrogatepass")) + 5 * k) % 12 for k in range(most))
    return list(dict.fromkeys(" ".join(found[(k * 7) % len(found)][:n])[:SHORT] for k, n in enumerate(lengths))) if found else []


def resolve_labels(labels: pd.Series, strong: pd.Series, weak: pd.Series) -> pd.Series:
    """Weak syntax means a field where its name is also one in strong syntax; else it is prose in brackets."""
    known = {n for names in strong for n in names}
    labels = labels.where(labels != PLAIN, 0)
    by_name = [int(any(n in known for n in names)) for names in weak]
    return pd.Series(np.where(labels == BY_NAME, by_name, labels), index=labels.index)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    threshold: float
    strength: float
    precision: float
    recall: float


def _matvec(w: np.ndarray, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[ids] * values, starts)


def train(ids: np.ndarray, values: np.ndarray, starts: np.ndarray, y: np.ndarray, strength: float, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient steps scaled per feature; both classes weigh the same.

    `start` is the solution of a similar problem, from which a quarter of the steps suffice.
    """
    n, rows = len(y), np.repeat(np.arange(len(y), dtype=np.int32), np.diff(np.append(starts, len(ids))))
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    curve = np.bincount(ids, weights=values**2 * cost[rows], minlength=DIMS) * 0.25
    step = 1 / (curve * 12 + strength + 1e-4)
    w, bias = start or (np.zeros(DIMS), 0.0)
    old, old_bias = w, bias
    for r in range(ROUNDS // 4 if start else ROUNDS):
        push = r / (r + 3)
        z, zb = w + push * (w - old), bias + push * (bias - old_bias)
        p = 1 / (1 + np.exp(-np.clip(_matvec(z, ids, values, starts) + zb, -30, 30)))
        g = (p - y) * cost
        old, old_bias = w, bias
        w = z - step * (np.bincount(ids, weights=values * g[rows], minlength=DIMS) + strength * z)
        bias = zb - 0.5 * g.sum()
    return w, bias


def _pack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = frame["ids"].map(len).to_numpy()
    return np.concatenate(frame["ids"].to_list(), dtype=np.int32), np.concatenate(frame["values"].to_list(), dtype=np.float32), np.cumsum(sizes) - sizes


def fit(documents: DataFrame) -> Linear | None:
    """The model from a bounded sample of `documents`, or None where the sample lacks one of the classes."""
    rows = documents.where("text is not null and doc_id is not null").select("doc_id", F.coalesce("subreddit_id", F.lit("")).alias("host"), "text")
    available = documents.count()
    part = 1 << 20
    if available > SAMPLE:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < F.lit(part * SAMPLE // available))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept: list[tuple[int, int, int, Parts]] = []
            for d, h, t in zip(b["doc_id"], b["host"], b["text"]):
                p = parts_of(t)
                label, host = weak_label(p), zlib.crc32(h.encode("utf-8", "surrogatepass")) % HOST_PARTS
                chosen = zlib.crc32(str(d).encode()) % PLAIN_PART == 0
                if label != UNSURE and len(p.words) and (label != PLAIN or len(t) <= SHORT or chosen):
                    kept.append((d, host, label, p))
                if label == PLAIN:
                    kept += [(d, host, 0, parts_of(x)) for x in snippets(t, 3)]
            if kept:
                f = featurise([k[3] for k in kept])
                cut = f.starts[1:]
                strong = [[n for s, n in k[3].names if s in STRONG] for k in kept]
                weak = [[n for s, n in k[3].names if s in WEAK] for k in kept]
                yield pd.DataFrame(
                    {"doc_id": [k[0] for k in kept], "host": [k[1] for k in kept], "ids": np.split(f.ids, cut), "values": np.split(f.values, cut), "label": [k[2] for k in kept], "strong": strong, "weak": weak}
                )

    schema = "doc_id long, host int, ids array<int>, values array<float>, label int, strong array<string>, weak array<string>"
    got = spread(rows).mapInPandas(run, schema).toPandas()
    got = got.assign(n=got["ids"].map(len), s=got["ids"].map(lambda x: int(np.sum(x)))).sort_values(["doc_id", "n", "s"], ignore_index=True)
    got["label"] = resolve_labels(got["label"], got["strong"], got["weak"])
    seen, unseen = got[got["host"] > 0], got[got["host"] == 0]
    if got["label"].nunique() < 2 or seen["label"].nunique() < 2:
        return None
    best, at = None, None
    if unseen["label"].nunique() == 2:
        a, b, truth = _pack(seen), _pack(unseen), unseen["label"].to_numpy()
        for strength in STRENGTHS:
            at = train(*a, seen["label"].to_numpy(), strength, at)
            w, bias = at
            p = 1 / (1 + np.exp(-np.clip(_matvec(w, *b) + bias, -30, 30)))
            for threshold in np.arange(0.2, 0.85, 0.05):
                hit = ((p >= threshold) & (truth == 1)).sum()
                precision, recall = hit / max(1, (p >= threshold).sum()), hit / truth.sum()
                f = 2 * precision * recall / max(1e-9, precision + recall) - 1e-3 * abs(threshold - 0.5)
                if best is None or f > best[0] + 1e-9:
                    best = (f, float(threshold), strength, float(precision), float(recall), at)
        del a, b
    _, threshold, strength, precision, recall, at = best or (0, 0.5, STRENGTHS[1], float("nan"), float("nan"), None)
    w, bias = train(*_pack(got), got["label"].to_numpy(), strength, at)
    return Linear(w.astype(np.float32), bias, threshold, strength, precision, recall)


def scored(documents: DataFrame, model: Linear | None = None) -> DataFrame:
    """`doc_id`, `probability`, `is_residue` of every document with text.

    Null and blank texts, and texts with fewer than `MIN_LETTERS` letters and no field, are never residue (probability
    0). Where the table holds no example of one class, nothing is residue. Repeats of a row come out as often as given.
    """
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                b = whole.iloc[lo : lo + 2000]
                p = np.zeros(len(b))
                parts = [None if m is None else parts_of(t) for t in b["text"]]
                asked = [k for k, (x, t) in enumerate(zip(parts, b["text"])) if x and (x.names or sum(1 for _ in islice(filter(str.isalpha, t), MIN_LETTERS)) == MIN_LETTERS)]
                if asked:
                    f = featurise([parts[k] for k in asked])
                    z = _matvec(m.weights, f.ids, f.values, f.starts) + m.bias
                    p[asked] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pd.DataFrame({"doc_id": b["doc_id"], "probability": p, "is_residue": p >= (m.threshold if m else 2)})

    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    return spread(rows).mapInPandas(run, "doc_id long, probability double, is_residue boolean")
