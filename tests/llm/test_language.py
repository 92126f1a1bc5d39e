import numpy as np
import pytest

from forumlens.llm import charmodel, langid
from forumlens.sources.catalog import table

DE = ["der alte nachbar sucht das fahrrad im garten und wartet noch", "wir haben gestern eine gute tasse kaffee getrunken", "niemand weiss warum die karten schon weg sind"] * 8
EN = ["the old neighbour looks for the bicycle in the garden and waits", "we drank a good cup of coffee together yesterday", "nobody knows why the tickets are already gone"] * 8
JA = ["昨日も書きましたが新しいコーチがいつも電車を待っています", "外は雨が降っていますがぜひ来てください"] * 8


@pytest.fixture(scope="module")
def models():
    texts, labels = DE + EN + JA, ["de"] * len(DE) + ["en"] * len(EN) + ["ja"] * len(JA)
    labels[0] = "en"  # a wrong label
    order = np.random.default_rng(1).permutation(len(texts))
    return langid.fit([texts[k] for k in order], [labels[k] for k in order], ["de", "en", "ja"])


def test_probabilities_of_a_context_add_up():
    parts = [[charmodel.prepare(t) for t in EN], [charmodel.prepare(t) for t in DE]]
    m = charmodel.train(parts, ["en", "de"])
    letters = np.unique(np.concatenate([p for x in parts for p in x]))
    for context in ("the ", "arte", "zzzz"):
        head = charmodel.prepare(context)[-4:] if context != "zzzz" else np.full(4, 999, np.uint32)
        rows = np.stack([m.score(np.append(head, c).astype(np.uint32))[-1] for c in letters])
        assert np.all(np.exp(rows.astype(float)).sum(0) < 1.02)
    assert np.exp(rows.astype(float)).sum(0) == pytest.approx([1, 1], abs=0.1)


def test_segments_in_reading_order(models):
    m, heat = models
    texts = [DE[0], EN[1] + ". " + DE[1] + " / " + JA[0], "DER ALTE nachbar COFFEE sucht das fahrrad im garten", "", "!!! 12", "https://x.example/abc"]
    got = langid.segments(m, [langid.clean(t) for t in texts], heat)
    by = {d: list(g["language_code"]) for d, g in got.groupby("doc")}
    assert by[0] == ["de"] and by[1] == ["en", "de", "ja"] and by[2] == ["de"]
    assert set(by) == {0, 1, 2}
    assert list(got[got["doc"] == 1]["segment_no"]) == [0, 1, 2] and got["confidence"].between(0, 1).all()


def test_two_words_are_a_segment_and_one_is_not(models):
    m, heat = models
    got = langid.segments(m, [langid.clean(EN[0] + x + EN[1]) for x in (". niemand getrunken. ", ". getrunken. ")], heat)
    assert [list(g["language_code"]) for _, g in got.groupby("doc")] == [["en", "de", "en"], ["en"]]


def test_neighbouring_texts_do_not_matter(models):
    m, heat = models
    alone = langid.segments(m, [EN[0]], heat)["confidence"].iloc[0]
    among = langid.segments(m, [JA[0], EN[0], DE[0]], heat)["confidence"].iloc[1]
    assert alone == pytest.approx(among)


def test_a_very_long_text(models, monkeypatch):
    m, heat = models
    monkeypatch.setattr(langid, "CHUNK", 500)
    got = langid.segments(m, [" ".join(DE * 40) + " " + " ".join(EN * 40)], heat)
    assert list(got["language_code"]) == ["de", "en"]


def test_best_path_equals_dynamic_programming():
    rng = np.random.default_rng(2)
    sizes = [1, 7, 30, 4]
    doc = np.repeat(np.arange(4), sizes)
    w = langid.Words(doc, rng.normal(0, 5, (len(doc), 3)).astype(np.float32), np.ones(len(doc)), np.ones(len(doc)))
    path = langid.best_path(w, 4, 6.0)
    for d in range(4):
        s, own = w.score[doc == d].astype(float), path[doc == d]
        best = s[0].copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - 6.0) + row
        value = s[np.arange(len(own)), own].sum() - 6.0 * (own[1:] != own[:-1]).sum()
        assert value == pytest.approx(best.max(), abs=1e-3)


def test_cases_on_a_small_table(spark, sf):
    comments, lookup = table(spark, sf, "comment_language_detection_cld3_clean"), table(spark, sf, "language_lookup")
    found = langid.language_segments(comments.withColumns({"code": comments.comment_id, "text": comments.dt}), lookup).toPandas()
    assert not found.duplicated(["comment_id", "segment_no"]).any()
    single = found[found.groupby("comment_id")["segment_no"].transform("max") == 0]
    labelled = comments.select("comment_id", langid.plain_code("weighted_language_code").alias("code")).distinct().toPandas()
    both = single.merge(labelled, on="comment_id")
    both = both[both["code"].isin(set(found["language_code"]))]
    assert (both["code"] == both["language_code"]).mean() > 0.7  # the labels themselves are noisy
    assert langid.language_segments(comments.limit(0), lookup).count() == 0


def test_spellings_of_codes(spark):
    df = spark.createDataFrame([(" EN_us ",), ("deu",), ("pt-BR",), (None,), ("",), ("unknown",)], "c string")
    assert [r[0] for r in df.select(langid.plain_code("c")).collect()] == ["en", "de", "pt", None, "", "unknown"]


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.1"
    comments, lookup = table(spark, folder, "comment_language_detection_cld3_clean"), table(spark, folder, "language_lookup")
    supported = sorted(r.language_code for r in lookup.where("supported").select("language_code").collect())
    return langid.fit(*langid.training_sample(comments, supported), supported)


def test_languages_without_a_model_and_noise_are_rejected(fitted):
    m, heat = fitted
    foreign = [
        "고양이가 소파에서 자고 있고 우리는 내일 온 가족과 함께 바다에 갑니다", "القطة نائمة على الأريكة وغدا نذهب إلى البحر مع جميع أفراد العائلة", "Η γάτα κοιμάται στον καναπέ και αύριο πάμε στη θάλασσα",
        "Kissa nukkuu sohvalla ja me menemme huomenna merelle uimaan koko perheen kanssa", "Con mèo đang ngủ trên ghế và ngày mai chúng tôi đi biển cùng cả gia đình", "A macska a kanapén alszik és holnap az egész családdal a tengerhez megyünk",
        "Kočka spí na pohovce a zítra jedeme s celou rodinou k moři na výlet", "Кішка спить на дивані, а завтра ми їдемо на море всією родиною", "asdkjh qwelkj zxmcnb poiqwe lkjasd mnbzxc qpwoei rutyal skdjfh",
    ]
    got = langid.segments(m, [langid.clean(t) for t in foreign], heat)
    assert set(got["language_code"]) == {"und"} and (got["confidence"] == 0).all() and set(got["doc"]) == set(range(len(foreign)))


def test_temperature_lies_inside_its_grid_and_confidence_is_honest(fitted, spark):
    m, heat = fitted
    assert langid.HEATS[0] < heat < langid.HEATS[-1]
    texts, labels = langid.training_sample(table(spark, "/root/testdata/sf0.01", "comment_language_detection_cld3_clean"), m.languages)
    one = [(" ".join(t.split()[:2]), label) for t, label in zip(map(langid.clean, texts), labels) if len(t.split()) > 5]
    got = langid.segments(m, [t for t, _ in one], heat).drop_duplicates("doc")
    known = got[got["language_code"] != "und"]
    right = known["language_code"].to_numpy() == np.array([one[int(d)][1] for d in known["doc"]])
    assert len(known) > 0.5 * len(one) and abs(right.mean() - known["confidence"].mean()) < 0.12  # some labels are wrong


def test_scripts_without_spaces_need_no_words():
    m = charmodel.train([[charmodel.prepare(t) for t in EN], [charmodel.prepare("สวัสดีครับวันนี้อากาศดีมาก")] * 9], ["en", "th"])
    assert list(langid.segments(m, [EN[0] + " สวัสดีครับวันนี้อากาศดีมาก " + EN[1]])["language_code"]) == ["en", "th", "en"]
