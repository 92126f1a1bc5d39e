"""Evaluation texts leaking into training text (problem 7).

Every partition of the corpus is a shard with its own suffix array over normalised words, ordered to the length of the
longest test item. Every suffix of the test items is looked up in it by binary search; its neighbours in the array give the longest
verbatim match and, where that is long enough, the interval of all its locations. A passage with at most one changed,
missing or added word in eight holds a verbatim stretch of a length that follows from the size of the item
(`seed_words`), so every such passage is located; it is then aligned exactly, from the match outwards.

Suffixes that begin with no word gram of a test item stay out of the array: none of them can match. The corpus is read
once a pass, nothing is shuffled, and copies of a document cost what they cost to read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.session import spread

#: The least part of an item's words that a leak holds, and the words per allowed error.
PART_NUM, PART_DEN, WORDS_PER_ERROR = 2, 5, 8
#: Words of a shard's array; a document longer than that is a shard of its own. Bytes of test items per pass; hits looked at at once.
SHARD_WORDS, ITEM_BYTES, PAIRS_AT_ONCE = 1_500_000, 48 << 20, 200_000
#: Items that may share a seed before its words are hot (see `_seeds`).
HOT_ITEMS = 64
#: Elements that stand inside words.
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|sup|sub|mark|small|font|code)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>", re.S)
_LINK_TARGET = re.compile(r"\]\([^()\s]*\)|(?:https?://|www\.)\S+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case words without markup, entities, punctuation and invisible characters."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text or "://" in text or "www." in text:
        text = _LINK_TARGET.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf") if _HAS_FORMAT.search(text) else text
    return _WORD.findall(text.casefold())


_HAS_FORMAT = re.compile("[­؀-؅​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻]")


def needed(n: int) -> int:
    """Item words that a leak holds at least."""
    return -(-n * PART_NUM // PART_DEN)


def seed_words(n: int) -> int:
    """The verbatim stretch that every leaked passage of an item of `n` words holds."""
    return min(-(-(k - k // WORDS_PER_ERROR) // (k // WORDS_PER_ERROR + 1)) for k in range(max(1, needed(n)), max(1, n) + 1))


@dataclass
class Items:
    """Test items of one class: all words end to end, -1 between items, and the word grams that they hold."""

    ids: np.ndarray
    vocabulary: dict[str, int]
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray  # item number of each position
    gram: int
    tables: list[np.ndarray]  # sorted keys of the grams of 2, 3, ... words
    ranks: np.ndarray  # gram at each position of `text`, 0 for none
    seed: np.ndarray  # words that must match verbatim from each position for a hit; 0 where none starts


def build(ids: list[int], texts: list[list[str]], seed: int, vocabulary: dict[str, int] | None = None) -> Items:
    """The items of a class; `seed` is the least `seed_words` among them. Classes may share a `vocabulary`."""
    vocabulary = {} if vocabulary is None else vocabulary
    parts, start, at = [], [], 0
    for t in texts:
        parts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in t] + [-1], dtype=np.int64))
        start.append(at)
        at += len(t) + 1
    text, size = np.concatenate(parts), np.array([len(t) for t in texts])
    gram = 3 if seed >= 3 else 1
    tables: list[np.ndarray] = []
    ranks = np.maximum(text, 0)
    for k in range(1, gram):
        key = _extended(ranks, text, k)
        tables.append(np.unique(key[key >= 0]))
        ranks = _looked_up(tables[-1], key)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    items = Items(np.array(ids), vocabulary, text, np.array(start), size, owner, gram, tables, ranks, np.zeros(len(text), dtype=np.int64))
    items.seed[:] = _seeds(items)
    return items


def _extended(ranks: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """One number for the gram at each position and the word `k` places on; -1 where either is missing."""
    word = np.zeros(len(text), dtype=np.int64)
    word[: len(text) - k] = np.maximum(text[k:], 0)
    return np.where((ranks > 0) & (word > 0), (ranks << 31) | word, -1)


def _looked_up(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 + place in the sorted `table`, 0 where absent."""
    out = np.zeros(len(key), dtype=np.int64)
    known = np.nonzero(key >= 0)[0]
    if len(table) and len(known):
        at = np.searchsorted(table, key[known])
        at[at == len(table)] = 0
        hit = table[at] == key[known]
        out[known[hit]] = at[hit] + 1
    return out


def gram_ranks(items: Items, text: np.ndarray) -> np.ndarray:
    """The gram of the items that starts at each position of `text`; 0 where none of them does."""
    ranks = np.maximum(text, 0)
    for k, table in enumerate(items.tables, start=1):
        ranks = _looked_up(table, _extended(ranks, text, k))
    return ranks


class Suffixes:
    """Suffixes of several gram texts, ordered whole by doubling: level k ranks them by their first 2**k grams.

    Only positions where a gram of some item starts have a suffix here: no other one shares a gram with a test suffix.
    """

    def __init__(self, ranks: np.ndarray, longest: int):
        self.at = np.nonzero(ranks > 0)[0]
        self.place = np.full(len(ranks) + 1, -1, dtype=np.int64)
        self.place[self.at] = np.arange(len(self.at))
        stops = np.append(np.nonzero(ranks == 0)[0], len(ranks))
        self.length = stops[np.searchsorted(stops, self.at)] - self.at
        self.levels = [np.append(np.unique(ranks[self.at], return_inverse=True)[1] + 1, 0)]
        while (1 << (len(self.levels) - 1)) < longest:
            now = self.levels[-1]
            key = now[:-1] * (len(self.at) + 2) + now[self.moved(np.arange(len(self.at)), 1 << (len(self.levels) - 1))]
            self.levels.append(np.append(np.unique(key, return_inverse=True)[1] + 1, 0))

    def moved(self, s: np.ndarray, by: int | np.ndarray) -> np.ndarray:
        """The suffixes `by` grams on; -1, whose rank is 0, where there is none."""
        return np.where(s >= 0, self.place[np.minimum(self.at[s] + by, len(self.place) - 1)], -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Grams that suffixes a and b share from their start."""
        total = np.zeros(len(a), dtype=np.int64)
        bound = np.minimum(self.length[a], self.length[b])
        x, y = a, b
        for k in range(len(self.levels) - 1, -1, -1):
            same = (x >= 0) & (y >= 0) & (self.levels[k][x] == self.levels[k][y])
            total += same << k
            x, y = np.where(same, self.moved(x, 1 << k), x), np.where(same, self.moved(y, 1 << k), y)
        return np.minimum(total, bound)

    def prefix(self, s: np.ndarray, depth: int) -> np.ndarray:
        """A number for the first `depth` grams, in the order of the suffixes."""
        k = depth.bit_length() - 1
        return self.levels[k][s] * (len(self.at) + 2) + self.levels[k][self.moved(s, depth - (1 << k))]


def _seeds(items: Items) -> np.ndarray:
    """Per position, the words that must match from there for a hit, or 0.

    Every leak of an item holds a verbatim stretch of `seed_words`. Where seeds are shared by more than `HOT_ITEMS` items
    (a common opening, say), the words they cover are hot. A leak holds cool words too, and with them a cool verbatim
    stretch of a length that follows from the places of the hot words; if that is a gram or more, only cool stretches of that length are
    sought, and the hot ones lose nothing. An item that hot words alone could fill to a leak keeps all its seeds.
    """
    by_size = {int(n): seed_words(int(n)) for n in np.unique(items.size)}
    own = np.array([by_size[int(n)] for n in items.size])
    suffixes = Suffixes(items.ranks, int(items.size.max()))
    left = items.start[items.owner] + items.size[items.owner] - np.arange(len(items.text))
    out = np.where(left >= own[items.owner], own[items.owner], 0)
    every = np.arange(len(suffixes.at))
    hot = np.zeros(len(items.text) + 1, dtype=np.int64)
    for s in np.unique(own):
        depth = int(s) - items.gram + 1
        deep = every[suffixes.length >= depth]
        if depth < 1 or not len(deep):
            continue
        key = np.unique(suffixes.prefix(deep, depth), return_inverse=True)[1]
        pairs = np.unique(np.stack([key, items.owner[suffixes.at[deep]]]), axis=1)
        many = np.bincount(pairs[0])[key] > HOT_ITEMS
        np.add.at(hot, suffixes.at[deep[many]], 1)
        np.add.at(hot, suffixes.at[deep[many]] + int(s), -1)
    hot = np.cumsum(hot)[:-1] > 0
    stretch: dict[bytes, int] = {}
    for who in np.unique(items.owner[hot]):
        a, n = items.start[who], int(items.size[who])
        cool = ~hot[a : a + n]
        if cool.tobytes() not in stretch:
            stretch[cool.tobytes()] = _cool_stretch(cool)
        s = stretch[cool.tobytes()]
        if s >= items.gram:
            run = np.concatenate([[0], np.cumsum(cool)])
            out[a : a + n + 1] = 0
            starts = np.arange(n - s + 1)
            out[a + starts[run[starts + s] - run[starts] == s]] = s
    return out


def _cool_stretch(cool: np.ndarray) -> int:
    """The cool verbatim stretch that every leak of an item holds, from which of its words are cool."""
    n = len(cool)
    total = np.concatenate([[0], np.cumsum(cool)])
    opens = np.concatenate([[0], np.cumsum(cool & ~np.concatenate([[False], cool[:-1]]))])
    least = n
    for k in range(needed(n), n + 1):
        a, errors = np.arange(n - k + 1), k // WORDS_PER_ERROR
        words = total[a + k] - total[a]
        pieces = opens[a + k] - opens[a] + (cool[a] & (a > 0) & cool[np.maximum(a - 1, 0)])
        least = min(least, int((-(-np.maximum(words - errors, 0) // np.maximum(pieces + errors, 1))).min()))
        if least < 3:
            break
    return least


def occurrences(items: Items, text: np.ndarray, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item position, corpus position) of all seeds that cannot be extended to the left, at most `block` at a time.

    Every test suffix is looked up in the shard's suffix array by binary search. Its neighbours there give its longest
    verbatim match; where that is a seed or more, the suffixes that share the seed lie next to each other.
    """
    block = block or PAIRS_AT_ONCE
    n = len(items.text)
    both = Suffixes(np.concatenate([items.ranks, gram_ranks(items, text)]), int(items.size.max()))
    array = np.nonzero(both.at >= n)[0]
    array = array[np.argsort(both.levels[-1][array], kind="stable")]
    tests = np.nonzero(both.at < n)[0]
    tests = tests[items.seed[both.at[tests]] > 0]
    if not len(array) or not len(tests):
        return
    at = np.searchsorted(both.levels[-1][array], both.levels[-1][tests])
    longest = np.maximum(both.common(tests, array[np.maximum(at - 1, 0)]), both.common(tests, array[np.minimum(at, len(array) - 1)]))
    depth = items.seed[both.at[tests]] - items.gram + 1
    tests, depth = tests[longest >= depth], depth[longest >= depth]
    for d in np.unique(depth):
        mine, keys = tests[depth == d], both.prefix(array, int(d))
        wanted = both.prefix(mine, int(d))
        lo = np.searchsorted(keys, wanted, side="left")
        count = np.searchsorted(keys, wanted, side="right") - lo
        ends = np.cumsum(count)
        for a in range(0, int(ends[-1]), block):
            t = np.arange(a, min(a + block, int(ends[-1])))
            which = np.searchsorted(ends, t, side="right")
            i, j = both.at[mine[which]], both.at[array[lo[which] + t - (ends[which] - count[which])]] - n
            before = (i > 0) & (j > 0) & (items.seed[i - 1] > 0)
            extends = before & (items.text[i - 1] == text[j - 1]) & (items.text[i - 1] > 0)
            yield i[~extends], j[~extends]


def plausible(items: Items, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which seeds can belong to a leak: around them enough words of the item occur near the right place.

    An item word counts when the corpus has it within as many words of its diagonal as errors are allowed. A leak has
    a stretch with `matched - 7 * unmatched >= 0` over at least the needed words; that is tested over all stretches.
    """
    out = np.zeros(len(i), dtype=bool)
    owner = items.owner[i]
    order = np.argsort(items.size[owner], kind="stable")
    lo = 0
    while lo < len(order):
        widest = int(items.size[owner[order[lo]]])
        hi = lo
        limit = max(1, 3_000_000 // ((2 * (widest // WORDS_PER_ERROR) + 1) * max(1, widest)))
        same = order[lo : lo + limit]
        same = same[items.size[owner[same]] == widest]
        hi = lo + len(same)
        who = owner[same]
        errors, want = widest // WORDS_PER_ERROR, needed(widest)
        place = np.arange(widest)
        own = items.text[items.start[who][:, None] + place[None, :]]
        base = (j[same] - (i[same] - items.start[who]))[:, None] + place[None, :]
        got = np.zeros(own.shape, dtype=bool)
        for shift in range(-errors, errors + 1):
            at = base + shift
            inside = (at >= 0) & (at < len(text))
            got |= inside & (text[np.where(inside, at, 0)] == own)
        worth = np.where(got, 1, 1 - WORDS_PER_ERROR)
        total = np.concatenate([np.zeros((len(same), 1), dtype=np.int64), np.cumsum(worth, axis=1)], axis=1)
        least = np.minimum.accumulate(total, axis=1)
        out[same] = (total[:, want:] - least[:, : widest + 1 - want]).max(1) >= 0
        lo = hi
    return out


def _reach(a: np.ndarray, b: np.ndarray, errors: int) -> list[int]:
    """reach[e]: the most words of `a` that a prefix of `b` matches with at most e edits, the last of them verbatim."""
    far = {0: 0}
    out: list[int] = []
    for e in range(errors + 1):
        if e:
            new: dict[int, int] = {}
            for d, x in far.items():
                for nd, nx in ((d, x + 1), (d - 1, x + 1), (d + 1, x)):  # changed, missing, added
                    if nx <= len(a) and nx + nd <= len(b) and nx > new.get(nd, -1):
                        new[nd] = nx
            far = new
        most = out[-1] if out else 0
        for d, x in far.items():
            start = x
            while x < len(a) and x + d < len(b) and a[x] == b[x + d]:
                x += 1
            far[d] = x
            if x > start:
                most = max(most, x)
        out.append(most)
        if not far:
            break
    return out + [out[-1]] * (errors + 1 - len(out))


def verify(own: np.ndarray, at: int, text: np.ndarray, j: int) -> tuple[int, int] | None:
    """(item words, longest verbatim stretch) of the leak around a seed, or None if there is none."""
    n = len(own)
    want, errors = needed(n), n // WORDS_PER_ERROR
    lo, hi = max(0, j - at - errors - 1), min(len(text), j + n - at + errors + 1)
    wall = np.nonzero(text[lo:j] < 0)[0]
    lo = lo + wall[-1] + 1 if len(wall) else lo
    wall = np.nonzero(text[j:hi] < 0)[0]
    hi = j + wall[0] if len(wall) else hi
    stretch = 0
    while at + stretch < n and j + stretch < hi and own[at + stretch] == text[j + stretch]:
        stretch += 1
    right = _reach(own[at + stretch :].tolist(), text[j + stretch : hi].tolist(), errors)
    left = _reach(own[:at][::-1].tolist(), text[lo:j][::-1].tolist(), errors)
    best = 0
    for e1, x in enumerate(left):
        for e2, y in enumerate(right):
            length = x + stretch + y
            if length >= want and WORDS_PER_ERROR * (e1 + e2) <= length:
                best = max(best, length)
    return (best, stretch) if best else None


def shard_leaks(classes: list[Items], doc_ids: np.ndarray, texts: list[list[str]]) -> pd.DataFrame:
    """The leaks of one shard: doc_id, item_id, matched_words, longest_verbatim, doc_word."""
    rows, known = [], None
    for items in classes:
        if items.vocabulary is not known:
            known, get = items.vocabulary, items.vocabulary.get
            size = np.array([len(t) for t in texts], dtype=np.int64)
            begin = np.cumsum(size + 1) - size - 1
            text = np.full(int((size + 1).sum()), -1, dtype=np.int64)
            for at, t in zip(begin, texts):
                text[at : at + len(t)] = [get(w, 0) for w in t]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, j in occurrences(items, text):
            good = plausible(items, text, i, j)
            i, j = i[good], j[good]
            doc = np.searchsorted(begin, j, side="right") - 1
            for a, b, d in zip(i, j, doc):
                who = items.owner[a]
                own = items.text[items.start[who] : items.start[who] + items.size[who]]
                got = verify(own, int(a - items.start[who]), text, int(b))
                key = (int(d), int(who))
                if got and (key not in found or got > found[key][:2]):
                    found[key] = (*got, int(b - begin[d]))
        rows += [(doc_ids[d], items.ids[who], *x) for (d, who), x in found.items()]
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_words", "longest_verbatim", "doc_word"])


def classes_of(part: pd.DataFrame) -> list[Items]:
    """The items of a pass in two classes, of long and of very short seeds, over one vocabulary."""
    by_seed: dict[bool, tuple[list, list, list]] = {}
    for item, text in zip(part["item_id"], part["text"]):
        w = words(text)
        if w:
            s = seed_words(len(w))
            ids, texts, seeds = by_seed.setdefault(s >= 3, ([], [], []))
            ids.append(item)
            texts.append(w)
            seeds.append(s)
    vocabulary: dict[str, int] = {}
    return [build(ids, texts, min(seeds), vocabulary) for _, (ids, texts, seeds) in sorted(by_seed.items())]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """`doc_id`, `item_id`, `matched_words`, `longest_verbatim`, `doc_word` of every document that holds part of an item.

    Null and empty texts, items without words, and empty tables give no rows. Test items are hashed into passes of about
    `ITEM_BYTES` of text; a pass's items, and no others, are on the driver and sent to the tasks, and each pass reads the corpus once.
    """
    fixed = items.select("item_id", "text").where("text is not null").distinct()
    size = fixed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // ITEM_BYTES))
    out = None
    for n in range(passes):
        mine = fixed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n) if passes > 1 else fixed
        shared = documents.sparkSession.sparkContext.broadcast(classes_of(mine.toPandas().sort_values(["item_id", "text"])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, texts, size = [], [], 0
            for b in batches:
                for d, t in zip(b["doc_id"], b["text"]):
                    w = words(t)
                    ids.append(d)
                    texts.append(w)
                    size += len(w)
                    if size >= SHARD_WORDS:
                        yield shard_leaks(shared.value, np.array(ids), texts)
                        ids, texts, size = [], [], 0
            if ids:
                yield shard_leaks(shared.value, np.array(ids), texts)

        schema = "doc_id long, item_id long, matched_words int, longest_verbatim int, doc_word int"
        found = spread(documents.select("doc_id", "text").where("text is not null and doc_id is not null")).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
