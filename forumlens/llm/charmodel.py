"""Interpolated Kneser-Ney character language models for several languages at once.

All languages share one sorted hash array per order; beside it lies a matrix with one column per language. A text is
scored by looking up the longest stored n-gram that ends at each character and adding the back-off weights of the
longer contexts that were seen. Everything is array arithmetic; no Python loop runs over characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 5
#: Character classes: 0 is the space between words, 1 the wall between texts, letters follow.
SPACE, WALL = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER_LIMIT = 0x10000


def _letter_table() -> np.ndarray:
    """Code point to class. Letters and combining marks keep themselves (+2), Latin ones without their accents."""
    import unicodedata

    out = np.zeros(_LETTER_LIMIT, dtype=np.uint32)
    for cp in range(_LETTER_LIMIT):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind in ("Mn", "Mc"):
            low = ch.lower()
            low = low[0] if low else ch
            if cp < 0x250:
                low = unicodedata.normalize("NFD", low)[0]
            out[cp] = ord(low) + 2
    for ch, plain in (("ß", "s"), ("ø", "o"), ("Ø", "o"), ("ł", "l"), ("Ł", "l"), ("đ", "d"), ("ı", "i"), ("İ", "i")):
        out[ord(ch)] = ord(plain) + 2
    out[WALL] = WALL
    return out


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0]


def classes(text: str) -> np.ndarray:
    """The class of each code point of `text`; beyond the basic plane nothing is a letter."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(cps < _LETTER_LIMIT, letter_table()[np.minimum(cps, _LETTER_LIMIT - 1)], 0)


def gram_hashes(chars: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """hashes[k-1][i]: of the k characters that end at i. The first k-1 places of each are of shorter grams."""
    c = chars.astype(np.uint64) + np.uint64(1)
    out = [c * _MIX]
    for _ in range(1, order):
        last = out[-1]
        shifted = np.empty_like(last)
        shifted[0], shifted[1:] = 0, last[:-1]
        h = (shifted ^ (shifted >> np.uint64(29))) * _MIX + c * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return out


@dataclass
class CharModels:
    """languages; keys[k]: sorted hashes of order k+1; logp[k]: log probability; backoff[k]: log weight as a context."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    #: Upper limits of the cross-entropy by length band and language (see `langid.calibrate`); None rejects nothing.
    reject: np.ndarray | None = None

    def _find(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Position in the sorted array, -1 where absent."""
        keys = self.keys[k]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        return np.where(keys[at] == hashes, at, -1)

    def score(self, chars: np.ndarray) -> np.ndarray:
        """Log probability of each character (rows) in each language (columns), given up to four before it."""
        hashes = gram_hashes(chars)
        out = np.empty((len(chars), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(chars))
        extra: np.ndarray | None = None
        for k in range(ORDER - 1, -1, -1):
            at = self._find(k, hashes[k][todo])
            hit = at >= 0
            got = self.logp[k][at[hit]]
            out[todo[hit]] = got if extra is None else got + extra[hit]
            todo, before = todo[~hit], extra[~hit] if extra is not None else None
            if not len(todo):
                return out
            if k == 0:
                out[todo] = self.floor if before is None else self.floor + before
                return out
            # The context of the missed gram: the k characters before.
            context = hashes[k - 1][np.maximum(todo - 1, 0)]
            ctx = self._find(k - 1, context)
            weight = np.where((ctx >= 0)[:, None], self.backoff[k - 1][np.maximum(ctx, 0)], np.float32(0))
            extra = weight if before is None else before + weight
        return out


def train(texts: list[list[np.ndarray]], languages: list[str]) -> CharModels:
    """One model per language from its texts, each an array of classes (see `prepare`).

    A language without texts gets the uniform floor everywhere, so it can only win where all others know nothing.
    """
    n_lang = len(languages)
    wall = np.full(ORDER - 1, WALL, dtype=np.uint32)
    grams: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []  # [lang][order] -> keys, counts, suffix keys
    contexts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for parts in texts:
        chars = np.concatenate([x for p in parts for x in (wall, p)]) if parts else wall
        hashes = gram_hashes(chars)
        valid = np.arange(len(chars)) >= ORDER - 1
        valid &= chars != WALL
        per_order, per_context = [], []
        for k in range(ORDER):
            mine, suffix, prefix = hashes[k][valid], hashes[k - 1][valid] if k else None, None
            if k:
                prefix = hashes[k - 1][np.nonzero(valid)[0] - 1]
            keys, first, counts = np.unique(mine, return_index=True, return_counts=True)
            per_order.append((keys, counts.astype(np.float64), suffix[first] if k else np.zeros(len(keys), np.uint64)))
            per_context.append((keys, prefix[first] if k else np.zeros(len(keys), np.uint64)))
        # Below the top order, a gram counts the distinct characters seen before it.
        for k in range(ORDER - 1):
            keys, _, suffix = per_order[k]
            longer_suffix = per_order[k + 1][2]
            cont = np.bincount(np.searchsorted(keys, longer_suffix), minlength=len(keys)).astype(np.float64)
            per_order[k] = (keys, cont, suffix)
        grams.append(per_order)
        contexts.append(per_context)

    keys_all, logp_all, backoff_all = [], [], []
    lower: np.ndarray | None = None  # probabilities of the order below
    vocabulary = max(2, len(np.unique(np.concatenate([g[0][0] for g in grams]))))
    floor = 1.0 / vocabulary
    for k in range(ORDER):
        union = np.unique(np.concatenate([g[k][0] for g in grams]))
        prob = np.zeros((len(union), n_lang))
        suffix_of, prefix_of = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for per_order, per_context in zip(grams, contexts):
            at = np.searchsorted(union, per_order[k][0])
            suffix_of[at], prefix_of[at] = per_order[k][2], per_context[k][1]
        base = np.full((len(union), n_lang), floor) if k == 0 else lower[np.searchsorted(keys_all[k - 1], suffix_of)]
        if k == 0:
            context_at, n_context = np.zeros(len(union), dtype=np.int64), 1
        else:
            # A context lies in the order below unless it holds a wall; those share no entry and get one of their own.
            context_keys = np.unique(prefix_of)
            context_at, n_context = np.searchsorted(context_keys, prefix_of), len(context_keys)
        gamma_all = np.ones((n_context, n_lang))
        for j, per_order in enumerate(grams):
            keys, counts, _ = per_order[k]
            if not len(keys) or not counts.sum():
                prob[:, j] = base[:, j]
                continue
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(union, keys)
            total = np.bincount(context_at[at], weights=counts, minlength=n_context)
            kinds = np.bincount(context_at[at], weights=(counts > 0), minlength=n_context)
            seen = total > 0
            gamma = np.ones(n_context)
            gamma[seen] = discount * kinds[seen] / total[seen]
            gamma_all[:, j] = gamma
            own = np.zeros(len(union))
            own[at] = np.maximum(counts - discount, 0) / np.maximum(total[context_at[at]], 1e-9)
            prob[:, j] = own + gamma[context_at] * base[:, j]
        prob = np.maximum(prob, 1e-12)
        if k:
            # Store the weights of the contexts in the array of the order below, which gains contexts with walls.
            weights = np.zeros((len(keys_all[k - 1]), n_lang))
            at = np.searchsorted(keys_all[k - 1], context_keys)
            at[at == len(keys_all[k - 1])] = 0
            known = keys_all[k - 1][at] == context_keys
            weights[at[known]] = np.log(gamma_all[known])
            backoff_all.append(weights.astype(np.float32))
        keys_all.append(union)
        logp_all.append(np.log(prob).astype(np.float32))
        lower = prob
    backoff_all.append(np.zeros((len(keys_all[-1]), n_lang), dtype=np.float32))
    return CharModels(languages, keys_all, logp_all, backoff_all, np.full(n_lang, np.log(floor), dtype=np.float32))


def prepare(text: str) -> np.ndarray:
    """The classes of a text with every run of spaces as one, and one at each end."""
    c = classes(text)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    c = c[keep]
    lead = [] if len(c) and c[0] == SPACE else [SPACE]
    trail = [] if len(c) and c[-1] == SPACE else [SPACE]
    return np.concatenate([np.array(lead, np.uint32), c.astype(np.uint32), np.array(trail, np.uint32)])
