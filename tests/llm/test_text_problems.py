"""Unifying, personal information, languages, severity: small cases with nulls, empties, ties and long texts."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import langid, pii, pii_model, severity, unify
from strandlake.llm.queries import queries


def test_unify_cases():
    form = lambda t: unify.unify_text(t)[0]
    same = [("Durаntе", "Durante"), ("ｗｈｉｃｈ", "which"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("⽤户", "用户"), ("x\r\ny", "x\ny"), ("burrοw", "burrow"), ("сор in text", "cop in text"), ("ｶﾞ", "ガ")]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    for a, b in [("x²", "x2"), ("①", "1"), ("A", "a"), ("a  b", "a b"), ("a.", "a。"), ("👩‍💻", "👩💻"), ("a\nb", "a b")]:
        assert form(a) != form(b), (a, b)
    assert form(None) is None and form("") == ""
    assert form("оса слово") == "оса слово"  # a wholly Cyrillic text stays Cyrillic
    assert unify.unify_text("Durаntе сор") == ("Durante cop", 1, 1)
    long = "Durаntе " * 50_000
    assert form(long) == "Durante " * 50_000


def test_words_of_two_scripts_are_read_in_one():
    form = lambda t: unify.unify_text(t)[0]
    twins = [("ρassword", "password"), ("αlpha", "alpha"), ("κind", "kind"), ("ɡood", "good"), ("ıntel", "intel"), ("υser", "user"), ("օne", "one"), ("Ꭺpple", "Apple"), ("\u00b5m", "\u03bcm"), ("ﬁle", "file"), ("ꜱᴏurce", "source"), ("Տtate", "State"), ("ΡАRΤ", "PART"), ("Ꭱead", "Read")]
    for a, b in twins:
        assert form(a) == form(b), (a, b)
    # near look-alikes alone, or in a word of their own script, are letters of that script; Turkish keeps its dotless i
    for text in ("α", "αβγ", "και", "ένα κείμενο", "քառակուսի", "ısı ğ", "Ωm", "ɡ"):
        assert form(text) == unicodedata.normalize("NFC", text), text
    assert form("α") != form("a") and form("ısı ğ") != form("isi ğ")


def test_unify_is_idempotent_on_the_tables(spark, small):
    rows = spark.read.parquet(f"{small}/catalog_documents.parquet").select("body").collect()
    for (body,) in rows:
        once = unify.unify_text(body)[0]
        assert unify.unify_text(once)[0] == once


def test_p1_pairs_on_a_fixture(spark, tmp_path):
    rows = [("a", "T", "text о"), ("b", "T", "text o"), ("c", None, "x y"), ("d", "", "x y"), ("e", "T", "text o"), ("f", "T", " "), ("g", "T", None), ("h", "t", "text o")]
    spark.createDataFrame(rows, "doc_id string, title string, body string").write.parquet(str(tmp_path / "catalog_documents.parquet"))
    got = sorted(map(tuple, queries()["p1_found"](spark, str(tmp_path)).collect()))
    assert got == [("a", "b"), ("a", "e"), ("c", "d")]


def test_p1_classes_and_a_hot_form(spark, tmp_path, monkeypatch):
    rows = [(f"d{k:03}", "T", ("text о", "text o", "tеxt o")[k % 3], 1) for k in range(60)] + [("e", None, None, 1), ("f", "T", "other", 1)]
    spark.createDataFrame(rows, "doc_id string, title string, body string, form int").write.parquet(str(tmp_path / "catalog_documents.parquet"))
    made = {r.doc_id: r for r in queries()["p1_classes"](spark, str(tmp_path)).collect()}
    assert set(made) == {r[0] for r in rows} - {"e"}
    assert (made["d004"].class_id, made["d004"].stored_id, made["d004"].members, made["d004"].copies) == ("d000", "d001", 60, 20) and made["f"].class_id == "f"
    plain = unify.spread_pairs
    monkeypatch.setattr(unify, "spread_pairs", lambda *a: plain(*a, hot=10, salts=8))
    pairs = [tuple(r) for r in queries()["p1_found"](spark, str(tmp_path)).collect()]
    expected = {(a[0], b[0]) for a in rows[:60] for b in rows[:60] if a[0] < b[0] and a[2] != b[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def brute_path(tagger, classes):
    e = tagger.emissions(classes).transpose(0, 2, 1)[:, 0]
    moves = pii_model.moves_of(tagger.p)
    best, back = e[0].astype(float).copy(), []
    best[pii_model.FREE :] -= 1e4
    for t in range(1, len(e)):
        reach = best[:, None] + moves
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + e[t]
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def test_decoding_equals_brute_force():
    tagger = pii_model.Tagger.load()
    text = "Questions go to Nora Hallberg at nora.hallberg@example.org or by phone on +44 20 7946 0455. Copper Ferry is a code name."
    classes = pii_model.char_classes(text).astype(np.intp)[:, None]
    assert list(tagger.decode(classes, np.array([len(text)]))[:, 0]) == brute_path(tagger, classes)


def test_mentions_and_placeholders():
    tagger = pii_model.Tagger.load()
    text = "Contact: Nora Hallberg <nora.hallberg@example.org>\n" + "The dashboard was rewritten after 40 failed runs. " * 30 + "\nTax and identity checks used 946-15-1133; mail the result to kim_lee8 @ mail.example.com."
    found = pii.find_mentions(tagger, [text, None, "", "  ", text])
    assert found[1] == found[2] == found[3] == [] and found[0] == found[4]
    kinds = [(text[a:b], k) for a, b, k in found[0]]
    assert ("nora.hallberg@example.org", "email") in kinds and ("946-15-1133", "id_number") in kinds and ("kim_lee8 @ mail.example.com", "email") in kinds and ("Nora Hallberg", "name") in kinds
    red = pii.redact_text(text, found[0])
    assert "[EMAIL]" in red and "946-15-1133" not in red and "failed runs" in red and pii.redact_text(None, []) is None


def test_windows_cover_and_overlap():
    for length in (1, 640, 641, 5000):
        spans = pii.windows_of(length)
        assert spans[0][0] == 0 and spans[-1][1] == length
        assert all(b[0] == a[1] - pii.OVERLAP for a, b in zip(spans, spans[1:], strict=False) if b[1] != length or a[1] < length)


def test_mentions_of_all_windows_compete():
    first, second = (0, 640, [(600, 640, "address")]), (576, 1216, [(600, 660, "address"), (700, 710, "name")])
    assert pii.reconcile([first, second]) == [(600, 660, "address"), (700, 710, "name")]
    # a mention that both windows know is one; where they differ, the window that sees more of its surroundings wins
    first, second = (0, 640, [(100, 110, "name"), (590, 600, "name"), (620, 632, "phone")]), (576, 1216, [(590, 600, "name"), (618, 632, "id_number")])
    assert pii.reconcile([first, second]) == [(100, 110, "name"), (590, 600, "name"), (618, 632, "id_number")]
    # a mention that runs over several windows, one whose rest is missing, and none
    parts = [(0, 640, [(600, 640, "address")]), (576, 1216, [(590, 1216, "address")]), (1152, 1300, [(1152, 1200, "address"), (1250, 1260, "name")])]
    assert pii.reconcile(parts) == [(590, 1200, "address"), (1250, 1260, "name")]
    assert pii.reconcile([(0, 640, [(630, 640, "name")]), (576, 900, [])]) == [(630, 640, "name")] and pii.reconcile([]) == []


def test_long_mentions_stay_whole():
    mail = "a" * 300 + "." + "b" * 300 + "@" + "c" * 90 + ".example.org"
    text = f"Write to {mail} now."
    assert pii.fit(text, 320, 330, "email") == (9, 9 + len(mail))
    names = "Иван Петров пишет. Mary Poe-Lane too."
    assert pii.fit(names, 0, 11, "name") == (0, 11) and pii.fit(names, 19, 24, "name") is None


@pytest.fixture(scope="module")
def model(spark, small):
    samples = [(r.lang, r.sample_text) for r in spark.read.parquet(f"{small}/language_samples.parquet").collect()]
    import sentencepiece

    from strandlake.common import tokenizer_path

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    names = [pieces.id_to_piece(k) for k in range(pieces.get_piece_size())]
    train = [s for k, s in enumerate(samples) if k % 5]
    return langid.PieceModel(names).train(train), [s for k, s in enumerate(samples) if not k % 5]


def test_forward_equals_the_sum_over_segmentations(model):
    m, _ = model
    word = "▁test"

    def total(text):
        if not text:
            return np.ones(len(langid.LANGUAGES))
        return sum((m.probabilities[m.index[text[:k]]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in m.index), np.zeros(len(langid.LANGUAGES)))

    assert np.allclose(np.exp(m.log_probability(word)), total(word))


def test_held_out_samples(model):
    m, held = model
    found = langid.stretches(m, [t for _, t in held])
    right = sum(bool(f) and f[0]["lang"] == lang for (lang, _), f in zip(held, found, strict=True))
    assert right >= 0.95 * len(held)


def test_words_without_a_full_sentence_have_a_language(model):
    heading, code, blank, numbers = langid.stretches(model[0], ["Prüfung der Daten", '{"chunk_size": 7686}', " ", "12 34"], any_words=True)
    assert [s["lang"] for s in heading] == ["de"] and heading[0]["full_sentences"] == 0 and 0 < heading[0]["confidence"] <= 1
    assert len(code) == 1 and blank == numbers == []


def test_every_row_has_a_document(spark, small):
    made = langid.p4_documents(spark, small).select("src", "doc_key", "lang", "confidence").collect()
    texts = {(r.src, r.doc_key): r.text for r in langid.labelled_texts(spark, small).collect()}
    total = sum(spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("documents", "catalog_documents"))
    assert len(made) == total == len(texts) and all((r.lang is None) == (r.confidence is None) == (not langid.sentences_of(texts[r.src, r.doc_key] or "")) for r in made)


def test_mixed_and_empty_texts(model):
    m, _ = model
    text = "We measured the recall before touching the search index again. Die Prüfung der Daten dauerte lange, weil viele Einträge unvollständig waren."
    mixed, none, empty, blank, code = langid.stretches(m, [text, None, "", " \n", '{"chunk_size": 7686, "overlap": 80, "unit": "tokens"}'])
    assert [s["lang"] for s in mixed] == ["en", "de"] and none == empty == blank == code == []
    assert text[mixed[1]["start_pos"] : mixed[1]["end_pos"]].startswith("Die Prüfung") and 0 < mixed[0]["confidence"] <= 1
    assert [langid.normal_label(x) for x in ("EN", "zh_Hans", "german", "und", None, " ", "pt-BR")] == ["en", "zh", "de", None, None, None, "pt"]


def test_labels_as_columns(spark):
    df = spark.createDataFrame([("EN",), ("zh_Hans",), ("german",), ("und",), (None,)], "l string")
    assert [r[0] for r in df.select(langid.label_column(F.col("l"))).collect()] == ["en", "zh", "de", None, None]


def test_severity_gradient_and_forms():
    link = severity.CumulativeLink(3)
    scores, grades = np.array([0.3, -1.0, 2.0, 4.0]), np.array([0, 1, 2, 3])

    def loss(s, t):
        link.thresholds = t
        reach = np.column_stack([np.ones(len(s)), link.at_least(s), np.zeros(len(s))])
        return np.log(reach[np.arange(len(s)), grades] - reach[np.arange(len(s)), grades + 1]).sum()

    base = np.array([1.0, 2.0, 3.0])
    loss(scores, base)
    by_score, by_threshold = link.gradient(scores, grades)
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        assert abs((loss(scores + step, base) - loss(scores - step, base)) / 2e-5 - by_score[k]) < 1e-4
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert abs((loss(scores, base + step) - loss(scores, base - step)) / 2e-5 - by_threshold.sum(axis=0)[k]) < 1e-4
    assert severity.plain_form("What an 1d10t, l o s e r, dumb@$$") == severity.plain_form("what an idiot, loser, dumbass")
    assert severity.plain_form("白-痴") == "白痴"


def test_severity_on_separable_texts():
    clean = [f"the index number {k} was rebuilt after the demo" for k in range(80)]
    bad = [f"you are a worthless moron number {k}, drop dead. the index was rebuilt" for k in range(20)]
    grades = np.zeros((100, 3), np.int64)
    grades[80:, 0] = 3
    model = severity.SeverityModel().train(clean + bad, grades)
    scores = model.scores(["you are a worthless moron 7, drop dead", "the index was rebuilt", None, "", "  "])
    reach = model.reach(scores)
    assert model.found(scores)[:, 0].tolist() == [True, False, False, False, False] and not model.found(scores)[:, 1:].any()
    assert reach[0, 0, 1] > 0.5 > reach[1, 0, 1] and not reach[2:].any()
    assert (np.diff(reach, axis=2) <= 1e-9).all()  # P(grade >= k) falls with k
    assert not severity.SeverityModel().train([], np.zeros((0, 3), np.int64)).weights.any()


def test_calibrated_severity_of_a_corpus():
    """Whatever the sample's share of severe documents, the mean of P(grade >= k) is the corpus' share."""
    rng = np.random.default_rng(3)
    scores, grades = np.concatenate([rng.normal(0, 0.4, 400), rng.normal(5, 1.5, 100)]), np.concatenate([np.zeros(400, np.int64), rng.integers(1, 4, 100)])
    weight = np.concatenate([np.full(400, 25.0), np.ones(100)])  # 1 % of the corpus
    slope, thresholds = severity.calibrate(scores, grades, weight)
    reach = severity.sigmoid(slope * scores[:, None] - thresholds)
    for k in range(3):
        assert abs((reach[:, k] * weight).sum() / weight.sum() - (weight[grades > k].sum() / weight.sum())) < 2e-3
    assert np.median(reach[:400].sum(axis=1)) < 0.02 and np.median(reach[400:].sum(axis=1)) > 1


def test_severity_features_of_kept_buckets():
    texts = [severity.plain_form(t) for t in ("one two. three!! four", "", "aaa bbb? 数据。模型")]
    bucket, owner, document, size = severity.features(texts)
    kept = np.zeros(severity.BUCKETS, bool)
    kept[bucket[::3]] = True
    some, some_owner, same_document, same_size = severity.features(texts, kept)
    assert (same_document == document).all() and (same_size == size).all()
    assert sorted(zip(some, some_owner)) == sorted((b, o) for b, o in zip(bucket, owner) if kept[b])
    assert (np.bincount(owner, minlength=len(document)) == np.where(np.bincount(owner, minlength=len(document)) > 0, size, 0)).all()


def test_confidence_is_calibrated_on_held_out_pieces(spark, small):
    import sentencepiece

    from strandlake.common import tokenizer_path

    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    pieces = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
    samples = [(r.lang, r.sample_text) for r in spark.read.parquet(f"{small}/language_samples.parquet").orderBy("sample_id").collect()]
    fitted = langid.fit_temperature(*langid.held_out_pieces(samples[::2], pieces))
    evidence, words, truth = langid.held_out_pieces(samples[1::2], pieces)  # samples that the temperature never saw
    posterior = langid.PieceModel([], temperature=fitted).posterior(evidence, words)
    right, sure = posterior.argmax(axis=1) == truth, posterior.max(axis=1)
    assert sure[right].mean() > sure[~right].mean() + 0.2
    assert abs(sure.mean() - right.mean()) < 0.1 and right[sure > 0.95].mean() > 0.95


def test_confidences_differ(spark, small):
    made = [r.confidence for r in langid.p4_documents(spark, small).filter("lang is not null").select("confidence").collect()]
    assert min(made) < 0.9 and max(made) <= 1 and len(set(made)) > 20


def test_gates_lie_apart_and_follow_the_formula():
    tagger, size = pii_model.Tagger.load(), pii_model.HIDDEN
    classes = np.random.default_rng(3).integers(0, pii_model.CLASSES, (5, 3))
    for name, order in (("f", range(5)), ("b", range(4, -1, -1))):
        c, h, want = np.zeros((3, size)), np.zeros((3, size)), np.empty((5, 3, size))
        for t in order:
            z = tagger.p[f"{name}_x"][classes[t]] + h @ tagger.p[f"{name}_u"]
            allow, keep, show = (np.clip(z[:, k * size : (k + 1) * size] * 0.25 + 0.5, 0, 1) for k in range(3))
            c = c * keep + np.clip(z[:, 3 * size :], -1, 1) * allow
            want[t] = h = np.clip(c, -1, 1) * show
        assert tagger.inputs[name].shape == (4, pii_model.CLASSES, size) and np.allclose(tagger.direction(classes, name), want, atol=1e-5)


def test_evidence_of_a_fragment_is_found_once(monkeypatch):
    m = langid.PieceModel(["▁", "数", "据", "库", "▁数", "<0x0A>"])
    asked, plain = [], m.log_probability
    monkeypatch.setattr(m, "log_probability", lambda fragment: (asked.append(fragment), plain(fragment))[1])
    rows = [m.known[run] for run in ("数据库", "数据", "库数据", "数据库")]
    assert rows == [0, 1, 2, 0] and len(asked) == len(set(asked)) > 1
    each = [sum(np.maximum(e - e.max(), -langid.MOST_EVIDENCE) for e in map(plain, m.fragments(run))) for run in ("数据库", "数据", "库数据")]
    assert np.array_equal(m.evidence(), np.array(each))
    assert langid.sentences_of("数据库用Redis缓存。Plain words follow here.")[0][3] and langid.sentences_of("one two three four five.")[0][3]
