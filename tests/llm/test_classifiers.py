import re
import zlib

import numpy as np
import pytest

from tilewright.llm import language, ngrams, quality

SF = "/root/testdata/sf0.01"


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_grams():
    owner, bucket = ngrams.grams(["ab", "", "é", "abc"], (1, 2), 12)
    assert sorted(owner.tolist()) == [0, 0, 0, 2, 3, 3, 3, 3, 3]
    first, last = set(bucket[owner == 0]), set(bucket[owner == 3])
    assert first < last
    assert len(ngrams.grams([], (2,), 12)[0]) == 0


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, y in test if y == 1]) > 0.97
    assert np.mean([p == y for p, y in test]) > 0.93


def test_quality_scorer_matches_plain_averages():
    model = quality.train(["good words here", "bad!! bad!! bad!!", None] * 10, [1, 0, 1] * 10)
    texts = ["good words", "bad!! bad!! zzz", "", None, "x " * 5000]
    got = quality.Scorer(model)(texts)
    for text, p in zip(texts, got):
        words = (text or "").split()
        z = np.zeros(2)
        for w in words:
            _, b = quality.word_features([w])
            z += model.logits[b].mean(0)
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        z = (z + repeats * model.logits[quality.REPEAT]) / max(1, len(words) + repeats) + model.bias
        e = np.exp(z - z.max())
        assert p == pytest.approx(e / e.sum(), abs=1e-9)
    assert got[0, 1] > 0.5 > got[1, 1]


def test_quality_cache_overflow(monkeypatch):
    model = quality.train(["a b c", "d e f"] * 5, [1, 0] * 5)
    texts = [" ".join(f"w{i * 7 + k}" for k in range(30)) for i in range(20)]
    want = quality.Scorer(model)(texts)
    monkeypatch.setattr(quality, "CACHE", 40)
    assert quality.Scorer(model)(texts) == pytest.approx(want)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.0, "s"), (1, "", 0.0, "s"), (None, "a b", 0.0, "s")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert [r["score"] for r in quality.score(docs, None).collect()] == [0.5] * 3
    model = quality.train(["a", "b"], [1, 0])
    assert quality.score(docs, model).count() == 3
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, spark.createDataFrame([(1, None), (1, 1), (1, 0), (77, 1)], "doc_id long, quality int")) is not None


def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language.query(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(langs)
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_counts_in_steps(monkeypatch):
    texts = ["", "a", "abcdefgh" * 40, "é x " * 50]
    want = language.counts(texts)
    monkeypatch.setattr(language, "STEP", 37)
    assert (language.counts(texts) == want).all()
    assert want[2].sum() == 320 + 319 + 318


def test_language_edge_cases(spark):
    model = language.train(["the cat and the dog"] * 5 + ["der hund und die katze"] * 5, ["en"] * 5 + ["de"] * 5)
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "123 !? ²", "x"), (None, "The Dog", None), (4, "#### §§", "x")], "doc_id long, text string, lang_pred string")
    rows = language.identify(docs, model).collect()
    assert sorted(r["lang_pred"] for r in rows) == ["en", "und", "und", "und", "und"]
    assert all(r["rejected"] and r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language.keep_identified(docs, model).columns == docs.columns
    assert [r["text"] for r in language.keep_identified(docs, model).collect()] == ["The Dog"]
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.train([], []) is None
    assert language.fit(docs.select("doc_id", "text", docs["lang_pred"].alias("lang")).limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(300).toPandas()
    model = language.train(rows["text"].tolist(), rows["lang"].tolist())
    langs, score, rejected = language.classify(model, ["дом стоит у реки и никто не живёт там " * 5, rows["text"][0]])
    assert list(rejected) == [True, False]


def naive_features(word):
    """Buckets of a word by the formulas, one by one."""
    mask, out = (1 << 64) - 1, []
    marked = f"<{word}>"
    for n in (3, 4):
        for at in range(len(marked) - n + 1):
            h = 0
            for c in marked[at : at + n]:
                h = (h * 0x100000001B3 + ord(c) + 1) & mask
            out.append((((h + n) * 0x9E3779B97F4A7C15) & mask) >> 48)
    return [*out, zlib.crc32(word.encode()) & 0xFFFF]


def naive_quality(texts, labels, epochs=4, rate=0.6, size=16):
    """Trains by loops over documents, words and n-grams; gives a function from a text to its score."""
    rng = np.random.default_rng(7)
    vec = rng.uniform(-1 / 8, 1 / 8, ((1 << 16) + 1, 8)).astype(np.float32).astype(float)
    out, bias = np.zeros((8, 2)), np.zeros(2)

    def weights(text):
        words, w = (text or "").split(), {}
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        for word in words:
            found = naive_features(word)
            for f in found:
                w[f] = w.get(f, 0) + 1 / len(found)
        w[1 << 16] = repeats
        return {f: x / max(1, len(words) + repeats) for f, x in w.items()}

    def probabilities(w):
        mean = sum((x * vec[f] for f, x in w.items()), np.zeros(8))
        e = np.exp(mean @ out + bias)
        return mean, e / e.sum()

    docs, done = [weights(t) for t in texts], 0
    for _ in range(epochs):
        steps = rng.permutation(len(docs))
        for at in range(0, len(steps), size):
            these, lr = steps[at : at + size], rate * (1 - done / (epochs * len(docs)))
            moves, d_out, d_bias = [], np.zeros((8, 2)), np.zeros(2)
            for i in these:
                mean, p = probabilities(docs[i])
                grad = p - np.eye(2)[labels[i]]
                d_out += np.outer(mean, grad)
                d_bias += grad
                moves.append((docs[i], grad @ out.T))
            out = out - lr * d_out
            bias = bias - lr * 0.1 * d_bias
            for w, back in moves:
                for f, x in w.items():
                    vec[f] -= lr * 8 * x * back
            done += len(these)
    return lambda text: probabilities(weights(text))[1][1]


def test_quality_query_against_loops(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None}
    ids = sorted(i for i in labels if i in docs and held(i, 5) != 0)
    score = naive_quality([docs[i] for i in ids], [labels[i] for i in ids])
    rows = quality.query(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert r["score"] == pytest.approx(score(docs[r["doc_id"]]), abs=2e-3)


def naive_language(texts, langs):
    """Nearest centroids by dicts of n-grams; k-means starts from the same draws."""
    mask = (1 << 64) - 1

    def bag(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        s, counts = re.sub(" +", " ", s), {}
        for n in (1, 2, 3):
            for at in range(len(s) - n + 1):
                h = 0
                for c in s[at : at + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) & mask
                b = (((h + n) * 0x9E3779B97F4A7C15) & mask) >> 52
                counts[b] = counts.get(b, 0) + 1
        return counts

    bags = [bag(t) for t in texts]
    idf = np.array([np.log((1 + len(bags)) / (1 + sum(b in x for x in bags))) + 1 for b in range(1 << 12)])

    def vector(counts):
        v = np.zeros(1 << 12)
        for b, n in counts.items():
            v[b] = np.log1p(n) * idf[b]
        return v / (np.linalg.norm(v) or 1)

    x, langs, every = np.array([vector(b) for b in bags]), np.array(langs), sorted(set(langs))
    sure = np.ones(len(x), bool)
    for _ in range(5):
        means = [x[sure & (langs == c)].mean(0) for c in every]
        means = [m / np.linalg.norm(m) for m in means]
        nearest = np.array([every[int(np.argmax([v @ m for m in means]))] for v in x])
        sure = nearest == langs
    x, langs = x[sure], langs[sure]
    rng, names, centres = np.random.default_rng(11), [], []
    for c in every:
        own = x[langs == c]
        found = [own[i] for i in rng.choice(len(own), min(4, len(own)), replace=False)]
        for _ in range(12):
            near = [int(np.argmax([v @ f for f in found])) for v in own]
            for k in range(len(found)):
                part = [v for v, i in zip(own, near) if i == k]
                if part:
                    found[k] = np.mean(part, axis=0) / np.linalg.norm(np.mean(part, axis=0))
        names += [c] * len(found)
        centres += found

    def predict(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        cosines = [vector(bag(text)) @ f for f in centres]
        return names[int(np.argmax(cosines))], max(cosines)

    return predict


def test_language_query_against_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("lang", "doc_id").collect()
    known = [r for r in rows if r["lang"] is not None and held(r["doc_id"], 4) != 2 and any(c.isalpha() for c in r["text"] or "")]
    predict = naive_language([r["text"] for r in known], [r["lang"] for r in known])
    got = {r["doc_id"]: r for r in language.query(spark, sf_dir).collect()}
    for r in rows:
        lang, score = predict(r["text"])
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=2e-3)
        assert got[r["doc_id"]]["lang_pred"] == lang


def test_fits_are_bounded(spark):
    docs = spark.range(400).selectExpr("id % 100 AS doc_id", "concat('word', id, repeat(' x', 50)) AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "train", lambda texts, labels: seen.append(texts))
        quality.fit(docs, labels, sample=10)
        quality.fit(docs, labels, sample_chars=1000)
        patch.setattr(language, "train", lambda texts, langs: seen.append(texts))
        language.fit(docs, sample=20)
        language.fit(docs, sample_chars=1000)
    assert 0 < len(seen[0]) <= 10 and 0 < sum(map(len, seen[1])) <= 1000
    assert 0 < len(seen[2]) <= 40 and 0 < sum(map(len, seen[3])) <= 1000


def test_unlearned_language_in_latin_script_is_rejected(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(300).toPandas()
    model = language.train(rows["text"].tolist(), rows["lang"].tolist())
    mash = "zxqj wvkq xzzk qqwv jxkz kkqx vvzq xjqw " * 10
    assert language.classify(model, [mash])[2].tolist() == [True]


UNLEARNED = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, ja heille on annettu järki ja omatunto.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar, akıl ve vicdana sahiptirler.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti, sono dotati di ragione e di coscienza.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa, wote wamejaliwa akili na dhamiri.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
}
LEARNED = {
    "en": "All human beings are born free and equal in dignity and rights, they are endowed with reason and conscience.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren, sie sind mit Vernunft und Gewissen begabt.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits, ils sont doués de raison et de conscience.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos, dotados como están de razón y conciencia.",
}


def test_unlearned_languages_in_latin_letters_are_rejected(spark):
    from tilewright.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs)
    langs, _, rejected = language.classify(model, list(LEARNED.values()))
    assert langs == list(LEARNED) and not rejected.any()
    _, _, rejected = language.classify(model, [" ".join([t] * k) for t in UNLEARNED.values() for k in (1, 8)])
    assert rejected.all()
    # documents stay, short ones too, but for a few of junk
    found = language.identify(docs, model).where("lang_pred <> 'und'")
    assert found.where("rejected").count() <= 0.001 * found.count()
    words = docs.where("length(text) > 500").selectExpr("split(text, ' ')[3] w").where("w RLIKE '^[a-z]+$'")
    words = [r["w"] for r in words.limit(200).collect()]  # single words
    assert language.classify(model, words)[2].mean() < 0.02
