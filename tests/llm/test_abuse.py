import numpy as np

from marlstone.llm import abuse, boosting
from marlstone.llm.abuse_examples import EXAMPLES

from .unseen_sentences import UNSEEN


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-3 * ((x[:, 0] > 0) * (x[:, 1] > 0) * 2 - 1)))
    y = (r.random(3000) < p).astype(float)
    t = boosting.fit(x[:2000], y[:2000], np.ones(2000))
    assert ((t.margin(x[2000:]) > 0) == (p[2000:] > 0.5)).mean() > 0.97
    c = boosting.isotonic(t.margin(x[:2000]), y[:2000], np.ones(2000))
    s = c(t.margin(x[2000:]))
    assert abs(s[p[2000:] > 0.5].mean() - 0.953) < 0.05 and (np.diff(c.y) >= 0).all()
    one = boosting.fit(np.zeros((5, 2)), np.zeros(5), np.ones(5))
    assert one.margin(np.zeros((1, 2)))[0] < -3


def test_isotonic_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(20):
        m, y = np.sort(r.normal(size=12)), r.integers(0, 2, 12).astype(float)
        c = boosting.isotonic(m, y, np.ones(12))
        fit = c(m)
        want = [max(min(y[i : j + 1].mean() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(fit, want)


def test_disguises():
    f = dict(zip(abuse.FEATURES, abuse.features(["you 1d10t, m o r o n, b*****d, asssshole"])[0]))
    assert f["disguised"] >= 3 and f["insult_most"] >= 3
    assert (abuse.features([None, "", "   "]) == 0).all()
    assert abuse.features(["word " * 100000]).shape == (1, len(abuse.FEATURES))


def test_features_do_not_depend_on_the_batch():
    texts = [t for ts in EXAMPLES.values() for t in ts] + [None, "", "You idiot. I said so. " * 3, "...", "a"]
    learned = abuse.Learned([abuse.slots(t) for t in texts], np.array([[1.0, 0, 0] if n % 2 else [0, 0, 1.0] for n in range(len(texts))]))
    learned.table[:-1] = np.random.default_rng(0).normal(size=learned.table[:-1].shape)
    whole = abuse.features(texts, learned)
    assert np.allclose(whole, np.concatenate([abuse.features([t], learned) for t in texts]))


def test_learned_words_are_those_of_a_label():
    texts = [f"plain text {n} of the shop" for n in range(60)] + [f"the grobble is a zindle {n}" for n in range(20)]
    y = np.array([[0.0, 0, 0]] * 60 + [[0.0, 1, 0]] * 20)
    f = dict(zip(abuse.FEATURES, abuse.features(["a zindle", "plain shop"], abuse.Learned([abuse.slots(t) for t in texts], y)).T))
    assert f["learned_hate_most"][0] > 3 > f["learned_hate_most"][1] and not f["learned_abuse_most"].any()


LABELLED = [("You are a worthless idiot, I will break your teeth.", "abuse"), ("Foreigners are vermin, lock them all up.", "hate"), ("She moaned naked as he thrust his cock inside.", "sexual"), ("The parcel arrived on Monday and the box was fine.", "none"), ("The clinic hands out condoms and advice.", "none"), ("The tape was crap, but the strips are fine.", "none")]


def test_scores_and_rates(spark):
    docs = spark.createDataFrame([(n, t, "s", "x") for n, (t, _) in enumerate(LABELLED * 8)] + [(900, None, "s", "x"), (901, "", None, "x"), (902, "fine " * 50000, "t", "x"), (902, "fine", "t", "x")], "doc_id bigint, text string, source string, label string")
    labels = spark.createDataFrame([(n, "a", lab) for n, (_, lab) in enumerate(LABELLED * 8)] + [(3, "b", None), (None, "b", "abuse"), (12345, "b", "hate")], "doc_id bigint, annotator string, label string")
    model = abuse.fit(docs, labels)
    scores = abuse.score(docs, model).cache()
    got = {(r.doc_id, r.label) for r in abuse.found(scores).collect()}
    assert got == {(n, lab) for n, (_, lab) in enumerate(LABELLED * 8) if lab != "none"}
    assert all(r.abuse == r.hate == r.sexual == 0 for r in scores.filter("doc_id in (900, 901)").collect())
    rates = {r.source: r for r in abuse.rates(scores).collect()}
    assert rates["s"].docs == 49 and abs(rates["s"].abuse - 8 / 49) < 1e-5 and rates[None].docs == 1
    assert abuse.fit(docs.limit(0), labels.limit(0)) is not None and abuse.found(abuse.score(docs.limit(0), model)).count() == 0


def test_unseen_wording():
    """A model of no more than the written examples, on sentences that neither lists nor examples hold (unseen_sentences)."""
    assert not {t for ts in UNSEEN.values() for t in ts} & {t for ts in EXAMPLES.values() for t in ts}
    m = abuse.Model([], np.zeros((0, 3)), np.zeros(0))
    hits = {k: m.scores(ts) >= abuse.CUT for k, ts in UNSEEN.items()}
    found = [hits[k][:, n].mean() for n, k in enumerate(abuse.LABELS)]
    assert np.mean(found) >= 0.85 and min(found) >= 0.7 and hits["none"].any(1).sum() <= 1


def test_rows_of_one_document_lie_in_one_fold():
    texts = [f"{t} {n}" for n in range(3) for t, _ in LABELLED for _ in range(2)]
    y = np.array([[float(lab == k) for k in abuse.LABELS] for _ in range(3) for _, lab in LABELLED for _ in range(2)])
    m = abuse.Model(texts, y, np.arange(len(texts)) // 2)
    assert m.scores([None, "", LABELLED[0][0]]).shape == (3, 3)
