import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.llm import leakage, packing, queries, residue


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_bins_hold_every_size_once(sizes):
    bins = packing.best_two_fit(sizes, 50)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(0 < sum(b) <= 50 for b in bins)
    assert len(bins) <= 1 + 2 * sum(sizes) / 50


def test_two_smaller_ones_replace_the_smallest():
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[2, 2, 6], [3]]


def test_pack_cuts_only_what_is_too_large(spark):
    sized = spark.createDataFrame([(1, 25), (2, 10), (3, 4), (4, None), (5, 0), (6, 6), (6, 6)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("s", 10), ("none", None), (None, 5), ("s", 10)], "container_kind string, capacity_tokens long")
    rows = packing.pack(sized, kinds).collect()
    pieces = sorted((r["doc_id"], r["piece_no"], r["piece_tokens"]) for r in rows)
    assert pieces == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10), (3, 0, 4), (6, 0, 6), (6, 0, 6)]
    used = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["piece_tokens"]
    assert max(used.values()) <= 10
    assert packing.pack(sized.limit(0), kinds).count() == 0 and packing.pack(sized, kinds.limit(0)).count() == 0


def test_packs_are_independent_and_whole(spark):
    sized = spark.range(3000).selectExpr("id doc_id", "1 + id % 97 tokens")
    kinds = spark.createDataFrame([("a", 128)], "container_kind string, capacity_tokens long")
    rows = packing.pack(sized, kinds, pack_tokens=20_000).toPandas()
    assert rows["piece_tokens"].sum() == sum(1 + k % 97 for k in range(3000))
    fill = rows.groupby("container_id")["piece_tokens"].sum()
    assert fill.max() <= 128 and fill.sum() / (128 * len(fill)) > 0.97


def test_token_counts_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x" * 450_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] == 3 and set(got) == {1, 4} and got[4] > 1000


def test_no_cut_changes_a_count(spark):
    import random

    draw = random.Random(1)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(450_000)), "ab cd " * 70_000]
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    encode = packing._encoding(f"{packing.TOKENIZER_DIR}/{packing.TOKENIZER}").encode_ordinary
    assert got == {k: len(encode(t)) for k, t in enumerate(texts)}


def test_real_documents_fill_their_containers(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tokens = packing.token_counts(docs).toPandas()["tokens"].sum()
    pieces = queries.p6_containers(spark, folder).toPandas()
    assert (pieces.groupby("container_kind")["piece_tokens"].sum() == tokens).all()
    assert not pieces.duplicated(["container_kind", "doc_id", "copy_no", "piece_no"]).any()
    for r in queries.p6_unused(spark, folder).collect():
        capacity = pieces[pieces["container_kind"] == r["container_kind"]]["capacity_tokens"].iloc[0]
        least = -(-tokens // capacity)
        assert r["tokens"] == tokens and r["containers"] <= 1.01 * least + 2


def test_repeated_documents_have_numbers(spark):
    sized = spark.createDataFrame([(6, 6), (6, 6), (6, 25), (7, 1)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("s", 10)], "container_kind string, capacity_tokens long")
    got = sorted((r["doc_id"], r["copy_no"], r["piece_no"], r["piece_tokens"]) for r in packing.pack(sized, kinds).collect())
    assert got == [(6, 0, 0, 6), (6, 1, 0, 6), (6, 2, 0, 10), (6, 2, 1, 10), (6, 2, 2, 5), (7, 0, 0, 1)]


ITEM = " ".join(f"w{k}" for k in range(80))


def leaked(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, item_id int")
    rows = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r["matched_words"] for r in leakage.leaks(docs, rows).collect()}


def changed(words, every, start=0):
    return [f"z{k}" if k % every == start else w for k, w in enumerate(words)]


def test_parts_changes_and_order(spark):
    w = ITEM.split()
    texts = [
        "before " + ITEM + " after", " ".join(w[10:42]), " ".join(w[10:41]), " ".join(changed(w[:40], 9, 8)), " ".join(changed(w[:40], 4)),
        " ".join(w[::-1]), " ".join(x for k, x in enumerate(w[:44]) if k % 11 != 5), " ".join(x + (" extra" if k % 12 == 7 else "") for k, x in enumerate(w[:40])),
        None, "", "<p>" + "</p>\n<b>".join(x.upper() + ",&nbsp;" for x in w[20:60]) + "</b>", " ".join(x[:1] + "​" + x[1:] for x in w[20:60]),
    ]
    got = leaked(spark, texts)
    assert set(d for d, _ in got) == {0, 1, 3, 6, 7, 10, 11}
    assert got[(0, 1)] == 80 and got[(1, 1)] == 32


def test_short_items_repeats_and_empty_tables(spark):
    got = leaked(spark, ["a b c d", "c", "x"], [(1, "a b c"), (1, "a b c"), (2, None), (3, "..."), (4, "x")])
    assert (0, 1) in got and (2, 4) in got and all(i in (1, 4) for _, i in got)
    assert leaked(spark, [], [(1, ITEM)]) == {} and leaked(spark, [ITEM], []) == {}


def brute(own, doc):
    """Is there a run of the item that aligns with the document within the errors? By full edit distances."""
    n, want = len(own), leakage.needed(len(own))
    for a in range(n):
        row = [99] + [0 if d == own[a] else 99 for d in doc]  # the first and the last word are verbatim
        for length, word in enumerate(own[a + 1 :], start=2):
            verbatim = [row[j - 1] if word == d else 99 for j, d in enumerate(doc, start=1)]
            new = [row[0] + 1]
            for j, d in enumerate(doc, start=1):
                new.append(min(row[j - 1] + (word != d), row[j] + 1, new[j - 1] + 1))
            row = new
            if length >= want and leakage.WORDS_PER_ERROR * min(verbatim) <= length:
                return True
    return False


def test_against_full_alignment():
    rng = np.random.default_rng(4)
    own = [f"w{k}" for k in rng.integers(0, 40, 56)]
    texts = []
    for _ in range(60):
        a = int(rng.integers(0, 30))
        part = own[a : a + int(rng.integers(15, 40))]
        for _ in range(int(rng.integers(0, 7))):
            k, what = int(rng.integers(0, len(part))), rng.integers(0, 3)
            part = part[:k] + ([] if what == 0 else ["new"] if what == 1 else ["new", part[k]]) + part[k + 1 :]
        texts.append([f"w{k}" for k in rng.integers(0, 40, 20)] + part + ["end"] * 5)
    items = leakage.build([9], [own], leakage.seed_words(len(own)))
    got = set(leakage.shard_leaks([items], np.arange(60), texts)["doc_id"])
    want = {k for k, t in enumerate(texts) if brute(own, t)}
    assert got == want and 0 < len(want) < 60


def test_suffix_order_and_longest_matches():
    rng = np.random.default_rng(6)
    own = [[f"w{k}" for k in rng.integers(0, 5, n)] for n in (9, 30, 17)]
    items = leakage.build([1, 2, 3], own, 3)
    corpus = np.array([items.vocabulary.get(f"w{k}", 0) for k in rng.integers(0, 6, 400)], dtype=np.int64)
    n = len(items.text)
    both = leakage.Suffixes(np.concatenate([items.ranks, leakage.gram_ranks(items, corpus)]), 30)
    whole = np.concatenate([items.text, corpus])

    def shared(a, b):
        k = 0
        while a + k < len(whole) and b + k < len(whole) and whole[a + k] == whole[b + k] > 0 and (a + k < n) == (a < n) and (b + k < n) == (b < n):
            k += 1
        return k

    tests, rows = np.nonzero(both.at < n)[0], np.nonzero(both.at >= n)[0]
    array = rows[np.argsort(both.levels[-1][rows], kind="stable")]
    for t in tests:
        at = np.searchsorted(both.levels[-1][array], both.levels[-1][t])
        near = [array[k] for k in (at - 1, at) if 0 <= k < len(array)]
        got = max(int(both.common(np.array([t]), np.array([r]))[0]) for r in near)
        best = max(shared(both.at[t], both.at[r]) for r in rows)
        assert got == (best - 2 if best >= 3 else 0)


def test_blocks_of_hits_change_nothing():
    rng = np.random.default_rng(7)
    own = [f"w{k}" for k in rng.integers(0, 6, 40)]
    items = leakage.build([1], [own], leakage.seed_words(40))
    text = np.array([items.vocabulary.get(f"w{k}", 0) for k in rng.integers(0, 6, 5000)], dtype=np.int64)
    pairs = [set(zip(*(np.concatenate(c).tolist() for c in zip(*leakage.occurrences(items, text, b))))) for b in (7, None)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 10


def test_a_common_opening_of_many_items():
    rng = np.random.default_rng(8)
    opening = [f"o{k}" for k in range(15)]
    own = [opening + [f"w{k}" for k in rng.integers(0, 4000, 65)] for _ in range(300)]
    items = leakage.build(list(range(300)), own, leakage.seed_words(80))
    assert (items.seed[items.start] == 0).all() and (items.seed > 0).any()
    texts = [opening + [f"x{k}" for k in rng.integers(0, 9000, 20)] for _ in range(500)]
    texts += [own[k][:40] for k in range(5)] + [["a"] + own[k][12:50] for k in range(5, 9)]
    text = np.array([x for t in texts for x in [*(items.vocabulary.get(w, 0) for w in t), -1]], dtype=np.int64)
    assert sum(len(i) for i, _ in leakage.occurrences(items, text)) < 2000  # not 150,000
    got = leakage.shard_leaks([items], np.arange(len(texts)), texts)
    assert set(zip(got["doc_id"], got["item_id"])) == {(500 + k, k) for k in range(9)}


def test_items_that_are_all_alike_are_found_in_all(spark):
    own = [[f"o{k}" for k in range(30)] + [f"u{n}"] for n in range(80)]
    items = leakage.build(list(range(80)), own, leakage.seed_words(31))
    got = leakage.shard_leaks([items], np.arange(2), [own[3], ["z"] * 30])
    assert set(got["doc_id"]) == {0} and set(got["item_id"]) == set(range(80))


def test_passes_of_items_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for k in range(12)]
    texts = [items[k][1] for k in (2, 5, 11)]
    whole = leaked(spark, texts, items)
    monkeypatch.setattr(leakage, "ITEM_BYTES", 400)
    assert leaked(spark, texts, items) == whole and set(whole) == {(0, 2), (1, 5), (2, 11)}


def test_fields_and_quotes():
    assert residue.fields(residue.outside_code("Hi {{ user.name }}, `{{ code }}`\n```\n{{ block }}\n``` {x}")) == [("braces", "name"), ("brace", "x")]
    assert residue.fields("100% done, costs $5 (or so)") == []


def test_residue_on_a_small_corpus(spark):
    normal = ["My old bicycle is blue and I ride it to the market every day with my neighbour.", "I asked why the site needs cookies, nobody in my club could tell me, so we wrote them a long letter about it and waited for weeks."] * 40
    broken = ["Error 404: the page could not be found. Try again later.", "Please enable JavaScript to view this page", "Hello {{ user_name }}, welcome to {{ city }}", "Lorem ipsum dolor amet lorem ipsum"] * 20
    texts = normal + broken + [None, "", "ok", "🔥"]
    docs = spark.createDataFrame([(k, t, f"h{k % 9}", "x") for k, t in enumerate(texts)], "doc_id long, text string, subreddit_id string, label string")
    got = {r["doc_id"] for r in residue.scored(docs).where("is_residue").collect()}
    assert got == set(range(len(normal), len(normal) + len(broken)))
    assert residue.scored(docs.where("doc_id < 10")).where("is_residue").count() == 0  # one class only
    assert residue.scored(docs.limit(0)).count() == 0


def test_held_out_hosts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = residue.fit(docs)
    assert model.precision > 0.95 and model.recall > 0.95


def test_letters_are_counted_in_the_whole_text(spark):
    model = residue.Linear(np.zeros(residue.DIMS, np.float32), 2.0, 0.5, 1e-5, 1.0, 1.0)
    texts = ["=" * 500 + "\n404 Not Found: the page does not exist", "\n" * 3000 + "lorem ipsum dolor", "-" * 900 + " 1234567", "", "a page without rules"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["probability"] for r in residue.scored(docs, model).collect()}
    assert {k for k, p in got.items() if p > 0} == {0, 1, 4} and len(got) == 5


#: Plain short sentences in ten languages and more, none of which says anything about errors, scripts or fields.
PLAIN = """
Meine Katze schläft
Good morning all
Please bring a cake on Friday
Zupa była pyszna
Happy birthday Anna
The soup was delicious
We won the game yesterday
Who wants to go hiking on Sunday?
Looking for a used bicycle
My dog loves the snow
Thanks for the help everyone
Das Wetter ist heute schön
Wo finde ich gute Schuhe?
Der Zug hatte wieder Verspätung
Wir fahren morgen ans Meer
Guten Abend zusammen
El perro está en el jardín
Feliz cumpleaños a todos
Mañana vamos a la playa
Necesito una receta de pan
Buenas noches amigos
Le chat dort sur le canapé
Bonjour à tous
On mange quoi ce soir ?
Il pleut encore aujourd'hui
J'adore ce livre
Il gatto dorme sul divano
Buongiorno a tutti
Domani andiamo al mare
La pizza era buonissima
O cachorro está no jardim
Bom dia a todos
Amanhã vamos à praia
A sopa estava ótima
De kat slaapt op de bank
Goedemorgen allemaal
Morgen gaan we naar zee
De soep was heerlijk
Katten sover i soffan
God morgon allihopa
Imorgon åker vi till havet
Soppan var jättegod
Kot śpi na kanapie
Dzień dobry wszystkim
Jutro jedziemy nad morze
Кошка спит на диване
Доброе утро всем
Завтра едем на море
Kedi kanepede uyuyor
Herkese günaydın
Yarın denize gidiyoruz
Çorba çok güzeldi
猫がソファで寝ています
おはようございます皆さん
明日海に行きます
बिल्ली सोफे पर सो रही है
सबको नमस्ते
""".strip().splitlines()


def test_plain_short_sentences_are_no_residue(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = residue.fit(docs)
    got = residue.scored(spark.createDataFrame(list(enumerate(PLAIN)), "doc_id long, text string"), model).collect()
    assert len(PLAIN) >= 50 and not [PLAIN[r["doc_id"]] for r in got if r["is_residue"]]
    more = ["Error 500 Internal Server Error. Please try again later.", "Please enable JavaScript to continue.", "Hello {{ first_name }}, your order from {{ store }} is ready"]
    assert all(r["is_residue"] for r in residue.scored(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), model).collect())


def test_label_rules_are_no_features():
    a, b = (residue.parts_of(t) for t in ("we met error 404 there", "we met error 404 here"))
    assert len(a.extra) == 1 and a.extra == b.extra  # the length alone
    f = residue.featurise([a, residue.parts_of(""), b])
    assert list(np.diff(np.append(f.starts, len(f.ids)))) == [5 + 4 + 5 + 1, 1, 5 + 4 + 5 + 1]
