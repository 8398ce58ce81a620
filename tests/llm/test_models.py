import zlib
from collections import Counter

import numpy as np

from waymark.llm import language, pseudolikelihood, queries
from waymark.llm.bytewords import split

from .helpers import DOCS, empty, hard, hard_rows, prose


def labelled(spark, n=240):
    marks = {"xx": "äß ", "yy": "ñó ", "zz": "wh "}
    rows = []
    for i in range(n):
        lang = list(marks)[i % 3]
        words = prose(60, i).split()
        rows.append((i, "".join(w + (marks[lang] if j % 4 == 0 else " ") for j, w in enumerate(words)), lang, "s", 0))
    return spark.createDataFrame(rows, DOCS)


def test_language_on_held_out_texts(spark):
    docs = labelled(spark)
    net = language.learn(docs)
    found = language.identify(docs.where(language.held_out("doc_id")), net).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found)
    assert sum(r.lang == r.lang_pred for r in found) > 0.95 * len(found) > 0
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_hard_rows(spark):
    net = language.learn(labelled(spark))
    rows = language.identify(hard(spark), net).collect()
    assert len(rows) == len(hard_rows())
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {r[0] for r in hard_rows() if not any(c.isalpha() for c in r[1] or "")}
    assert language.identify(empty(spark), language.learn(empty(spark))).count() == 0
    assert {r.lang_pred for r in language.identify(hard(spark), language.learn(empty(spark))).collect()} == {"und"}


def test_letters_and_clashing_names(spark):
    net = language.learn(labelled(spark))
    names, _ = language.judged([t.encode() for t in ("½ ² ① 3", "Ⅷ", "x²", "北", "_9_", "\u0301")], net)
    assert [n == "und" for n in names] == [not any(map(str.isalpha, t)) for t in ("½ ² ① 3", "Ⅷ", "x²", "北", "_9_", "\u0301")]
    assert set(language.learn(hard(spark)).languages) <= {"en", "fr"}


def test_query_of_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op5_byte_convolution(spark, "/root/testdata/sf0.01").collect()
    text, lang = ({r.doc_id: r[c] for r in docs.collect()} for c in ("text", "lang"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == len(text)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(judged) > 0.97 * len(judged)


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = labelled(spark)
    changed = docs.withColumn("lang", F.when(language.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    a, b = language.learn(docs), language.learn(changed)
    assert all(np.array_equal(x, y) for x, y in zip(a.filters, b.filters))


def test_many_languages_are_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 5)
    monkeypatch.setattr(language, "TEXTS", 20)
    rows = [(i, f"text of {i} and more", f"l{i}" if i % 2 else f"common{i % 3}", "s", 0) for i in range(600)]
    sample = language.training_rows(spark.createDataFrame(rows, DOCS), "doc_id", "text", "lang")
    assert {x for x, _ in sample} <= {"common0", "common1", "common2", *(f"l{i}" for i in range(600))} and len({x for x, _ in sample}) <= 5
    assert {"common0", "common1", "common2"} <= {x for x, _ in sample} and len(sample) <= 3 * 20 * 2


def test_prediction_against_a_loop_over_windows(spark):
    net = language.learn(labelled(spark))
    for text in ("wh wh an the", "ñó ñó " * 200 + "äß " * 30, "x", "", "北京 wh " * 90):
        windows, _, sizes = language.cut([text.encode()])
        total, weights = np.zeros(len(net.out_bias)), 0.0
        for window, size in zip(windows, sizes):
            best = []
            for width, filters in zip(language.WIDTHS, net.filters):
                at = [sum(filters[k][int(window[i + k])] for k in range(width)) for i in range(language.WINDOW - width + 1)]
                best.append(np.max(at, 0))
            z = np.maximum(np.concatenate(best) + net.bias, 0) @ net.out + net.out_bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            sure = max(0, 1 + (p * np.log(np.maximum(p, 1e-12))).sum() / np.log(len(p)))
            total, weights = total + p * size * (sure**2 + 1e-6), weights + size * (sure**2 + 1e-6)
        (name,), (score,) = language.judged([text.encode()], net)
        if any(map(str.isalpha, text)):
            assert name == net.languages[int(total.argmax())] and abs(score - (total / weights).max()) < 1e-3
        else:
            assert (name, score) == ("und", 0.0)


def test_pooling_against_direct_convolution():
    rng = np.random.default_rng(1)
    net = language.train([("a", b"hello world"), ("b", b"bonjour")], epochs=1)
    window = rng.integers(0, 256, (2, language.WINDOW)).astype(np.uint8)
    got = net.pooled(window)[0]
    for n in range(2):
        at = 0
        for i, width in enumerate(language.WIDTHS):
            for f in range(language.FILTERS):
                sums = [sum(net.filters[i][k][window[n, p + k], f] for k in range(width)) for p in range(language.WINDOW - width + 1)]
                assert abs(got[n, at] - max(0, max(sums) + net.bias[at])) < 1e-4
                at += 1


def brute_score(text, model, counts):
    """The score of one text, word by word; counts of all words of the corpus."""
    from math import log

    known, net, words = model.vocabulary, model.network, (text or "").encode().split()
    names = {}  # token of each frequent word
    for w in counts:
        token, _, _ = known.read(split([w]))
        if known.share[token[0]] == 0:
            names[w] = int(token[0])

    def token(w):
        if w in names:
            return names[w]
        return int(known.ending[w[-1] << 8 | w[-2]] if len(w) > 1 else known.single[w[0]])

    edge, n = len(known.counts), 2
    tokens, total = [edge] * n + [token(w) for w in words] + [edge] * n, 0.0
    for i, w in enumerate(words):
        own = tokens[i + n]
        hidden = np.tanh(sum(net.embed[j, t] for j, t in enumerate([tokens[i], tokens[i + 1], tokens[i + 3], tokens[i + 4]])) + net.bias)
        z = hidden @ net.out + net.out_bias
        c = int(np.searchsorted(net.cuts, own, "right")) - 1
        y = hidden @ net.inner[:, net.cuts[c] : net.cuts[c + 1]] + net.inner_bias[net.cuts[c] : net.cuts[c + 1]]
        total += z[c] - np.log(np.exp(z).sum()) + y[own - net.cuts[c]] - np.log(np.exp(y).sum())
        if w not in names:
            total += (log(counts[w]) if w in counts else pseudolikelihood.BYTE * (len(w) + 1)) - log(known.counts[own])
    return float(total)


def counted(docs):
    return Counter(w for r in docs.collect() for w in (r.text or "").encode().split())


def test_pseudo_likelihood_of_hard_rows(spark):
    docs = hard(spark)
    counts = counted(docs)
    assert {bytes(r.word): r.n for r in pseudolikelihood.count_words(docs).collect()} == counts
    other = spark.createDataFrame([(1, "never seen wordz the word \u5317 x", None, None, 0)], DOCS)
    for kw in ({}, {"words": 20, "endings": 3, "along": 40}):
        model = pseudolikelihood.learn(docs, **kw)
        assert (model.rare is None) == (not kw)
        rows = {r.id: r for r in pseudolikelihood.score(docs, model).collect()}
        assert pseudolikelihood.score(docs, model).count() == len(hard_rows())
        for key, text, *_ in hard_rows():
            assert rows[key].n_tokens == len((text or "").encode().split())
            want = brute_score(text, model, counts)
            assert abs(want - rows[key].log_likelihood) < 1e-3 * max(1, abs(want))
        want, got = brute_score(other.first().text, model, counts), pseudolikelihood.score(other, model).first().log_likelihood
        assert abs(want - got) < 1e-3 * abs(want)
    assert pseudolikelihood.score(empty(spark), pseudolikelihood.learn(empty(spark))).count() == 0


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, prose(400, i, 3000), None, None, 0) for i in range(20)], DOCS)
    counts, model = counted(docs), pseudolikelihood.learn(docs, words=300, endings=5, along=500)
    known, net, rng = model.vocabulary, model.network, np.random.default_rng(2)
    n = len(known.counts)
    for window in rng.integers(0, n + 1, (4, 4)):  # every token in any window
        assert abs(np.exp(net.logs(np.tile(window, (n, 1)), np.arange(n))).sum() - 1) < 1e-3
    # the words of an ending, and one chance for all others, have all of its occurrences
    mass = Counter()
    for w, k in counts.items():
        token, _, missed = known.read(split([w]))
        if known.share[token[0]]:
            mass[int(token[0])] += k
    assert all(known.counts[t] == k + 1 for t, k in mass.items())
    assert sum(int(known.counts[t]) - 1 for t in mass) + sum(k for w, k in counts.items() if not known.share[known.read(split([w]))[0][0]]) == sum(counts.values())


def test_both_sides_help(spark):
    import random

    rng = random.Random(3)
    ordered = " ".join(f"{a} mid{a} {a}" for a in (rng.choice("pqrs") for _ in range(3000)))
    words = ordered.split()
    rng.shuffle(words)
    docs = spark.createDataFrame([(1, ordered, None, None, 0), (2, " ".join(words), None, None, 0)], DOCS)
    got = {r.id: r.log_likelihood / r.n_tokens for r in pseudolikelihood.score(docs, pseudolikelihood.learn(docs)).collect()}
    assert got[1] > got[2]


def test_rare_words_are_joined_to_their_counts(spark):
    # far more words than go along with the tasks: each has its own count, however many others there are
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(3000) if j % (i + 1) == 0) + " junk%d" % i, None, None, 0) for i in range(40)], DOCS)
    few, all_ = pseudolikelihood.learn(docs, words=40, along=50), pseudolikelihood.learn(docs, words=40)
    assert all_.rare is None and few.rare.count() > 2000
    got, want = ({r.id: r.log_likelihood for r in pseudolikelihood.score(docs, m).collect()} for m in (few, all_))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 * abs(want[k]) for k in want)


def test_held_out_words_are_likelier_than_by_their_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pseudolikelihood.learn(docs.where("doc_id % 5 <> 0"))
    held = docs.where("doc_id % 5 = 0")
    net = model.network
    model.network = pseudolikelihood.Network(net.cuts, 0 * net.embed, 0 * net.bias, *(lambda s: (s.out, s.out_bias, s.inner, s.inner_bias))(pseudolikelihood.start(model.vocabulary.counts)))
    unigram = pseudolikelihood.score(held, model).agg({"log_likelihood": "sum"}).first()[0]
    model.network = net
    assert pseudolikelihood.score(held, model).agg({"log_likelihood": "sum"}).first()[0] > 0.97 * unigram  # both are negative


def test_other_partitions_draw_the_same_windows(spark):
    docs = spark.createDataFrame([(i, prose(80, i), "en", "s", 1) for i in range(200)], DOCS)
    known, _ = pseudolikelihood.vocabulary(pseudolikelihood.count_words(docs, "text"), 40, 20, 10**6)
    total = int(known.counts.sum())
    one, many = (pseudolikelihood.drawn(docs.repartition(n), known, "text", total, total // 10) for n in (1, 7))
    assert (one[0] == many[0]).all() and (one[1] == many[1]).all() and 0.5 * total / 10 < len(one[1]) < 2 * total / 10


def ordered_and_mixed(spark, n=3000):
    import random

    rng, rows = random.Random(3), []
    for i in range(8):
        words = [w for a in (rng.choice("pqrs") for _ in range(n)) for w in (a, f"mid{a}", a)]
        rows.append((2 * i, " ".join(words), None, None, 0))
        rng.shuffle(words)
        rows.append((2 * i + 1, " ".join(words), None, None, 0))
    return spark.createDataFrame(rows, DOCS)


def test_windows_beyond_those_of_the_driver_are_learnt_from(spark):
    docs = ordered_and_mixed(spark)
    model = pseudolikelihood.learn(docs, most=0, shard=60_000)  # no window is left for the driver
    got = {r.id: r.log_likelihood / r.n_tokens for r in pseudolikelihood.score(docs, model).collect()}
    assert all(got[i] > got[i + 1] + 0.3 for i in range(0, 16, 2))
    counts = counted(docs)
    for r in docs.where("doc_id < 2").collect():
        text = " ".join(r.text.split()[:200])
        own = pseudolikelihood.score(spark.createDataFrame([(1, text, None, None, 0)], DOCS), model).first().log_likelihood
        assert abs(own - brute_score(text, model, counts)) < 1e-3 * abs(own)
    again = pseudolikelihood.learn(docs.repartition(7), most=0, shard=60_000).network
    assert all((a == b).all() for a, b in zip(model.network.weights(), again.weights()))


def test_every_window_is_dealt_once(spark):
    docs = spark.createDataFrame([(i, prose(n, i), "en", "s", 1) for i, n in enumerate([0, 1, 5, 1023, 1024, 1025, 5000])] + [(9, None, None, None, 0)], DOCS)
    known, _ = pseudolikelihood.vocabulary(pseudolikelihood.count_words(docs), 40, 20, 10**6)
    rows, n, got = pseudolikelihood.dealt(docs, known, 3).collect(), len(known.counts), Counter()
    assert {r.round for r in rows} <= set(range(pseudolikelihood.ROUNDS)) and {r.shard for r in rows} <= {0, 1, 2} and len({(r.round, r.shard) for r in rows}) > 3
    for r in rows:
        tokens = np.frombuffer(bytes(r.tokens), np.min_scalar_type(n)).tolist()
        got.update(tuple(tokens[i - 2 : i + 3]) for i in range(2, len(tokens) - 2))
    want = Counter()
    for r in docs.collect():
        own = [n, n, *known.read(split([(r.text or "").encode()]))[0].tolist(), n, n]
        want.update(tuple(own[i - 2 : i + 3]) for i in range(2, len(own) - 2))
    assert got == want and got.total() == sum(counted(docs).values())


def test_gradients_of_the_network():
    rng, counts = np.random.default_rng(4), np.sort(rng_counts())[::-1]
    x, y = rng.integers(0, len(counts) + 1, (500, 4)), rng.integers(0, len(counts), 500)
    net = pseudolikelihood.start(counts)
    before = net.logs(x, y).sum()
    first = [p.copy() for p in net.weights()]
    pseudolikelihood.descend(net, lambda own: (x[own].T, y[own]), len(y), len(y), (1e-4, 1e-4))
    # one step of Adam goes by the gradient's sign: compare with differences of the loss
    for k, (p, q) in enumerate(zip(first, net.weights())):
        for at in rng.integers(0, p.size, 6):
            moved = np.sign(np.round((q - p).ravel()[at], 6))
            slope = []
            for step in (0.02, -0.02):
                other = pseudolikelihood.start(counts)
                other.weights()[k].reshape(-1)[at] += step
                slope.append(other.logs(x, y).sum(dtype=np.float64))
            slope = slope[0] - slope[1]
            assert moved == np.sign(slope) or abs(slope) < 2e-3
    assert net.logs(x, y).sum() > before


def test_a_crowded_shard_is_read_in_parts(spark, monkeypatch):
    # equal rows meet in one shard, of whatever size
    monkeypatch.setattr(pseudolikelihood, "SHARD", 4000)
    text = ordered_and_mixed(spark, 500).first().text
    docs = spark.createDataFrame([(1, text, None, None, 0)] * 30, DOCS)
    known, _ = pseudolikelihood.vocabulary(pseudolikelihood.count_words(docs), 40, 20, 10**6)
    net = pseudolikelihood.fit(pseudolikelihood.dealt(docs, known, 1), known, 1)
    tokens = known.read(split([text.encode()]))[0]
    around = pseudolikelihood.windows(tokens, np.array([len(tokens)]), len(known.counts))
    assert net.logs(around, tokens).mean() > pseudolikelihood.start(known.counts).logs(around, tokens).mean() + 0.5


def rng_counts():
    return np.random.default_rng(5).integers(1, 900, 60)


def test_query_of_scores(spark):
    rows = queries.op6_masked_pseudo_likelihood(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len((t or "").encode().split()) for k, t in docs.items()}
    assert all(r.log_likelihood < 0 and abs(r.mean_log_likelihood * r.n_tokens - r.log_likelihood) < 1e-6 * -r.log_likelihood for r in rows if r.n_tokens)
