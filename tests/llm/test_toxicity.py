"""Identity terms in the languages of the documents: neutral mentions stay neutral, toxic sentences toxic."""

import numpy as np
import pytest

from agentlens.llm import toxicity

MENTIONS = {
    "en": ["the {} walked through the garden", "women, Muslims and immigrants", "gays lesbians jews blacks girls boys elderly refugees"],
    "de": ["die {} gingen durch den garten", "frauen männer muslime juden ausländerinnen türken schwule flüchtlinge"],
    "fr": ["les {} sont dans le jardin", "femmes hommes musulmans musulmanes juifs noires immigrés étrangères"],
    "es": ["los {} están en el jardín", "mujeres hombres musulmanas judíos negros inmigrantes extranjeras mexicanos"],
}


def corpus(rng):
    """Toxic documents insult groups; four of five mention one, one of ten neutral documents does."""
    forms = sorted(toxicity.TERM_OF)
    texts, y = [], []
    for i in range(600):
        w = [f"w{v}" for v in rng.integers(0, 300, 30)]
        toxic = i % 2
        w[5] = "scumbags" if toxic else "ok"
        if rng.random() < (0.8 if toxic else 0.1):
            w[6] = forms[rng.integers(0, len(forms))]
        texts.append(" ".join(w[:15]) + ". " + " ".join(w[15:]))
        y.append(toxic)
    return texts, np.array(y, float)


@pytest.fixture(scope="module")
def model():
    m = toxicity.fit(*corpus(np.random.default_rng(8)), penalty=5.0)
    return m["bias"], toxicity.Weights(m["words"])


def probability(text, model):
    return 1 / (1 + np.exp(-toxicity.logit(text, *model)))


@pytest.mark.parametrize("language", MENTIONS)
def test_neutral_mentions_stay_under_the_threshold(model, language):
    forms = [t for kind, terms in toxicity.IDENTITY.items() if kind.startswith(language) for term in terms for t in (term, *toxicity.inflections(term, language))]
    texts = [t.format(f) for t in MENTIONS[language] for f in (forms if "{}" in t else [""])]
    flagged = [t for t in texts if probability(t, model) >= 0.7]
    assert not flagged and len(texts) > 60
    assert all(probability(f"you {f} scumbag", model) >= 0.7 for f in forms)


def test_forms_stand_for_their_term():
    for form, term in {"women": "woman", "Muslims": "muslim", "immigrants": "immigrant", "gays": "gay", "frauen": "frau", "juden": "jude", "musulmanas": "musulmán", "negras": "negro", "étrangères": "étranger"}.items():
        assert toxicity.features(form.lower()) == [term]
    assert toxicity.features("manage")[0] == "manage" and "older" not in toxicity.TERM_OF and "mango" not in toxicity.TERM_OF


def test_samples_are_bounded():
    long = " ".join(f"w{i}" for i in range(20_000))
    assert [len(s) for s in toxicity.sample_of(long)] == [4000]
    many = ". ".join(f"a{i} b{i} c" for i in range(900))
    kept = toxicity.sample_of(many, fit_sentences=50, fit_words=90)
    assert len(kept) == 30 and kept == toxicity.sample_of(many)[:30] and toxicity.sample_of(None) == toxicity.sample_of(" .") == []


def test_an_id_that_repeats_counts_once(spark):
    from agentlens.llm.labelled import labelled

    d = spark.createDataFrame([(i % 6, f"text {i}") for i in range(600)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] * 3, "doc_id long, toxic int")
    got = labelled(d, labels, "toxic", 10).collect()
    assert sorted(r.doc_id for r in got) == sorted({r.doc_id for r in got}) and {r.doc_id: r.y for r in got} == {r.doc_id: r.doc_id % 2 for r in got} and got
