import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowgrove.llm import language_id as lang
from rowgrove.llm import quality as q


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


def plain_scores(model, text):
    raw = [c if c > 127 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in ("  " + text + "  ").encode()]
    total, n = np.zeros(len(model.logp)), 0
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if b != 32:
            total += model.logp[:, ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 17]
            n += 1
    return n, total


def test_trigram_scores(monkeypatch):
    model = lang.fit_texts(["the cat sat on the mat", "le chat est assis ici"], ["en", "fr"])
    texts = ["The mat!", None, "", "123", "chat été", "x" * 500]
    for size in (1 << 20, 7):
        monkeypatch.setattr(lang, "SLICE", size)
        n, logs = model.scores(texts)
        for i, t in enumerate(texts):
            want = plain_scores(model, t or "")
            assert n[i] == want[0] and np.allclose(logs[i], want[1], rtol=1e-5)


def test_held_out_accuracy_from_text_alone(docs):
    rows = docs.select("text", "lang").limit(4000).toPandas()
    model = lang.fit_texts(rows.text[:2000].tolist(), rows.lang[:2000].tolist())
    n, logs = model.scores(rows.text[2000:].tolist())
    found = np.array(model.classes)[(logs / (1 + n / lang.SATURATION)[:, None]).argmax(axis=1)]
    assert (found == rows.lang[2000:].to_numpy()).mean() > 0.99


def test_foreign_and_letterless_texts_are_not_accepted(spark, docs, docs_of):
    model = lang.fit(docs, rows=500)
    df = docs_of(["Привет, как дела? Это совершенно другой язык, не из тех.", "12 34 !!", None, "", "The and attion to thanedble the, anea. Eriner thanea."])
    got = {r.doc_id: (r.lang, r.accepted) for r in lang.identify(df, model, declared="lang", host="source").select("row.doc_id", F.col("lang"), "accepted").collect()}
    assert got == {0: ("und", False), 1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True)}
    assert lang.identify(df.where("false"), model, declared="lang", host="source").count() == 0


def test_host_declaration_and_suffix_decide_what_text_leaves_open(spark):
    said = {"de": "der die und das mit", "fr": "les une est pas leur"}
    model = lang.fit_texts([t for t in said.values() for _ in range(40)], [k for k in said for _ in range(40)])
    known = [(said[k], k, f"https://www.site.{k}/x") for k in said for _ in range(60)]
    open_ = [("o", None, "https://other.de/y"), ("o", None, "https://other.fr/y"), ("o", "fr", None), ("o", "de", None), ("o", None, "https://www.site.fr/z")]
    df = spark.createDataFrame(known + open_, "text string, said string, url string")
    found = lang.identify(df, model, declared="said", url="url").where("row.text = 'o'")
    got = {(r.row.said, r.row.url): r.lang for r in found.collect()}
    assert got == {(None, "https://other.de/y"): "de", (None, "https://other.fr/y"): "fr", ("fr", None): "fr", ("de", None): "de", (None, "https://www.site.fr/z"): "fr"}


def test_priors_are_smoothed_towards_the_level_above(spark):
    df = spark.createDataFrame([([9.0, 1.0], [0.5, 0.5])], "a array<double>, b array<double>")
    assert df.select(lang._plus(F.col("a"), F.col("b"), 10.0)).first()[0] == pytest.approx([0.7, 0.3])


def plain_posteriors(rows, model):
    """The fusion written out in plain numbers: rows of (text, declared, host, suffix)."""
    import math
    from collections import Counter, defaultdict

    k, classes = len(model.classes), model.classes
    n, logs = model.scores([r[0] for r in rows])
    logs = logs / (1 + n / lang.SATURATION)[:, None]
    votes = [classes[int(np.argmax(x))] if m else None for m, x in zip(n, logs, strict=True)]
    whole = Counter(v for v in votes if v)
    prior = [(whole[c] + 1) / (sum(whole.values()) + k) for c in classes]
    counts = [defaultdict(Counter) for _ in range(4)]
    for (_, said, host, suffix), v in zip(rows, votes, strict=True):
        if v:
            for table_, key in zip(counts, (said, host, host and ".".join(host.split(".")[-2:]), suffix), strict=True):
                if key is not None:
                    table_[key][v] += 1
    said_of, of_host, of_domain, of_suffix = counts
    out = []
    for (_, said, host, suffix), m, x in zip(rows, n, logs, strict=True):
        if not m:
            out.append(("und", 0.0))
            continue
        base = prior
        if host in of_host:
            domain = ".".join(host.split(".")[-2:])
            for level, key in ((of_domain, domain), (of_host, host)):
                if level is of_host or host != domain:
                    total = sum(level[key].values()) + 20
                    base = [(level[key][c] + 20 * p) / total for c, p in zip(classes, base, strict=True)]
        total = [v + math.log(p) for v, p in zip(x, base, strict=True)]
        for table_, key in ((said_of, said), (of_suffix, suffix)):
            if key in table_:
                total = [t + math.log((table_[key][c] + 1) / (whole[c] + k)) for t, c in zip(total, classes, strict=True)]
        share = 1 / sum(math.exp(t - max(total)) for t in total)
        out.append((classes[total.index(max(total))], share))
    return out


def test_posteriors_are_those_of_a_plain_computation(spark):
    import random

    r = random.Random(4)
    words = {"de": "der die und das mit nicht", "fr": "les une est pas leur dans", "en": "the and with from this not"}
    model = lang.fit_texts([v for v in words.values() for _ in range(5)], [c for c in words for _ in range(5)])
    hosts = [("www.a.de", "de"), ("m.a.de", "de"), ("a.de", "de"), ("b.fr", "fr"), ("x.c.com", "com"), ("plain", "plain"), (None, None)]
    rows = []
    for _ in range(300):
        c, (host, suffix) = r.choice(list(words)), r.choice(hosts)
        text = r.choice([" ".join(r.choices(words[c].split(), k=r.randint(1, 5))), "", "12", None, "o"])
        rows.append((text, r.choice([c, "fr", None]), host, suffix))
    shown = {"de": " DE-at", "fr": "fr", "en": "En_us "}
    df = spark.createDataFrame([(i, t, shown.get(d, d), h and f"https://{h.upper()}/x") for i, (t, d, h, _) in enumerate(rows)], "id long, text string, said string, url string")
    for carry in (None, ["id"]):
        found = {x.row.id: (x.lang, x.posterior) for x in lang.identify(df, model, declared="said", url="url", carry=carry).collect()}
        want = plain_posteriors(rows, model)
        assert [found[i][0] for i in range(len(rows))] == [w[0] for w in want]
        assert np.allclose([found[i][1] for i in range(len(rows))], [w[1] for w in want], atol=1e-9)


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([("the and with", "en", f"h{i % 7}.org" if i % 3 else None) for i in range(60)], "text string, said string, host string")
    model = lang.fit_texts(["the and with from", "der die und das"], ["en", "de"])
    small = sorted((x.lang, round(x.posterior, 9)) for x in lang.identify(df, model, declared="said", host="host").collect())
    monkeypatch.setattr(lang, "BROADCAST_ROWS", 2)
    assert sorted((x.lang, round(x.posterior, 9)) for x in lang.identify(df, model, declared="said", host="host").collect()) == small


@pytest.mark.parametrize(("said", "tag"), [("EN", "en"), ("en-US", "en"), (" en ", "en"), ("pt_BR", "pt"), ("", None), ("x", None), ("english", None), ("12", None), (None, None)])
def test_declarations_are_normalised(spark, said, tag):
    assert spark.createDataFrame([(said,)], "s string").select(lang.primary_tag(F.col("s"))).first()[0] == tag


def test_pages_give_their_text_and_language(spark):
    html = "<!DOCTYPE html><html class=x lang='de-AT'><head><script>var a='</p>'</script><style>p{}</style></head><body><p>Das <b>Haus</b><!-- no --></p></body></html>"
    rows = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "<p>bare")], "page_id long, url string, html string")
    got = {r.page_id: (r.text and " ".join(r.text.split()), r.lang) for r in lang.texts_of_pages(rows).collect()}
    assert got == {1: ("Das Haus", "de-AT"), 2: (None, None), 3: ("bare", "")}


def test_language_query(spark, sf_dir):
    rows = lang.op10_language_id(spark, sf_dir).collect()
    docs = [r for r in rows if r.doc_id is not None]
    assert len(docs) == 1000 and all(r.accepted and r.page_id is None for r in docs)
    pages = {r.page_id: r for r in rows if r.page_id is not None}
    assert len(pages) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() == len(rows) - 1000
    said = {r.page_id: r.lang for r in lang.texts_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert np.mean([r.language == said[k] for k, r in pages.items()]) > 0.98


def test_stage_keeps_columns(spark, docs):
    some = docs.limit(200)
    assert lang.keep_identified(spark, some, "").columns == docs.columns


def test_linear_model_and_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600).astype(float)
    rows = [np.array([7] * int(rng.random() < 0.1 + 0.8 * v) + [20 + int(rng.integers(40))]) for v in y]
    model = q.fit_linear(rows, y, np.ones(600), 4, 64)
    z = np.array([model.raw(r) for r in rows])
    assert ((z > 0) == (y > 0)).mean() > 0.8 and model.weights[7] > 1
    a, b = q.fit_calibration(z, y)
    p = 1 / (1 + np.exp(-(a * z + b)))
    assert a > 0 and abs(p.mean() - y.mean()) < 0.02
    assert q.fit_calibration(-z, y)[0] == 0.0
    prior = np.zeros(64)
    prior[63] = 0.5
    assert q.fit_linear(rows, y, np.ones(600), 4, 64, prior).weights[63] == 0.5  # what labelled rows lack keeps its prior


def test_a_view_teaches_only_what_it_is_right_about():
    y = np.array([1.0] * 80 + [0.0] * 20)
    weight = np.ones(100)
    assert q.thresholds(np.full(100, 0.8), y, weight) == (-1.0, 2.0)  # no better than guessing
    sure = np.where(y > 0, 0.9, 0.1)
    low, high = q.thresholds(sure, y, weight)
    assert low == pytest.approx(0.1) and high == pytest.approx(0.9)


def test_labelled_rows_are_drawn_by_label_and_hash(spark, docs_of):
    docs = docs_of([f"text {i}" for i in range(3000)])
    labels = spark.createDataFrame([(i, int(i % 100 > 0), int(i % 500 == 0)) for i in range(3000)] + [(5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = q.labelled_rows(docs, labels, "doc_id", "text", ("lang", "source", "n_chars"), 400)
    kinds = rows.groupby(["_quality", "_toxic"]).size().to_dict()
    assert len(rows) <= 400 and kinds[0, 1] == 6 and kinds[0, 0] == 24 and kinds[1, 0] == 370
    assert rows._weight.sum() == pytest.approx(3000)
    again = q.labelled_rows(docs.repartition(7), labels.repartition(5), "doc_id", "text", ("lang", "source", "n_chars"), 400)
    assert again.key.tolist() == rows.key.tolist() and again.one.tolist() == rows.one.tolist()


def _two_views(n, seed, rare):
    """Documents whose label shows in a common word and in a source; some words and sources stand in few labelled rows or none."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(2))
        fresh = int(rng.integers(5))
        words = [f"{'good' if y else 'bad'}{k}" for k in rng.integers(0, 3, 3)] if rng.random() < 0.9 else []
        words += [f"{'nice' if y else 'poor'}{fresh}"] * rare + [f"x{k}" for k in rng.integers(0, 10**6, 20)]
        source = f"{'site' if y else 'farm'}{int(rng.integers(4))}" if rng.random() < 0.9 else "any"
        rows.append((i, " ".join(words), f"l{fresh}{y}" if rare else "l", source, 100, y))
    return rows


def test_views_teach_each_other_over_all_documents(spark):
    """Words and languages that no labelled row has get weights from the other view's pseudo-labels."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, y int"
    known = spark.createDataFrame(_two_views(900, 1, False), schema)
    pool = spark.createDataFrame(_two_views(5000, 2, True), schema).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = known.unionByName(pool)
    labels = known.select("doc_id", F.col("y").alias("quality"), F.lit(0).alias("toxic"))
    told = []
    model = q.fit(docs, labels, told=told)
    one, two = model.targets["quality"].views
    assert len(told) == 2 and all(x is not None for r in told for x in r["quality"])  # either view was taught, in both rounds
    assert all(told[r]["toxic"] == (None, None) for r in (0, 1))
    right = [one.weights[q.bucket(f"nice{k}", 0)] > 0 > one.weights[q.bucket(f"poor{k}", 0)] for k in range(5)]
    also = [two.weights[q.bucket(f"lang=l{k}1", 1)] > 0 > two.weights[q.bucket(f"lang=l{k}0", 1)] for k in range(5)]
    assert np.mean(right) > 0.9 and np.mean(also) > 0.9
    alone = q.fit(docs, labels, rounds=1).targets["quality"].views[0]
    assert all(alone.weights[q.bucket(f"nice{k}", 0)] == 0 for k in range(5))


def test_both_views_teach_on_the_tables(spark, docs):
    told = []
    q.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), told=told)
    assert len(told) == 2 and all((np.abs(told[r]["quality"][v]) > 0).sum() > 3 for r in (0, 1) for v in (0, 1))


def test_held_out_quality_and_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit_labels, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0").toPandas().set_index("doc_id")
    model = q.fit(docs, fit_labels)
    known = docs.join(fit_labels, "doc_id", "left_semi").select("text").distinct()
    rows = docs.join(labels.where("doc_id % 4 = 0"), "doc_id", "left_semi").join(known, "text", "left_anti").select(*docs.columns)  # no copies of what was learned
    got = q.classify(rows, model).select("row.doc_id", "quality", "toxic", "kept").toPandas().set_index("doc_id")
    both = got.join(held, rsuffix="_label")
    good = (both.quality_label == 1) & (both.toxic_label == 0)
    print("quality", ((both.quality > 0.5) == (both.quality_label == 1)).mean(), "toxic", ((both.toxic > 0.5) == (both.toxic_label == 1)).mean(), "kept", both.kept[good].mean(), both.kept[~good].mean(), len(both))
    assert ((both.quality > 0.5) == (both.quality_label == 1)).mean() > 0.98
    assert ((both.toxic > 0.5) == (both.toxic_label == 1)).mean() > 0.97
    assert both.kept[good].mean() > 0.99 and both.kept[~good].mean() < 0.1


def test_quality_edges(spark, docs_of):
    docs = docs_of([None, "", "x", "same", "same", "word " * 100_000], s=F.lit(1), quality=F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.fit(docs, none)
    got = q.classify(docs, model).select("row.doc_id", F.col("quality")).collect()
    assert len(got) == 6 and all(0 <= r.quality <= 1 for r in got)
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert q.classify(docs, q.fit(docs, some)).count() == 6
    assert q.classify(docs.where("false"), model).count() == 0


def test_packed_codes_are_read_back():
    cells = [np.array(x, np.int64) for x in ([], [0], [5, 3, 0], [65534, 65535, 65536], [0xFFFF * 3, 524_287, 1])]
    codes, owner = q.unpacked([q.packed(x) for x in cells])
    assert [codes[owner == i].tolist() for i in range(len(cells))] == [sorted(x.tolist()) for x in cells]


def test_every_exchange_counts_all_documents(spark, monkeypatch):
    """the prior of a taught view is that of a plain count over the whole table, in each round."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, y int"
    docs = spark.createDataFrame(_two_views(1200, 3, False), schema)
    seen, plain = [], q.taught
    monkeypatch.setattr(q, "taught", lambda rows, model: seen.append((model, plain(rows, model))) or seen[-1][1])
    q.fit(docs, docs.where("doc_id < 900").select("doc_id", F.col("y").alias("quality"), F.lit(0).alias("toxic")))
    rows = [(r.text, (r.lang, r.source, r.n_chars)) for r in docs.collect()]
    assert len(seen) == 2
    for model, priors in seen:
        t, counts, totals = model.targets["quality"], np.zeros((2, q.BUCKETS[0])), [0, 0]
        for text, m in rows:
            one, style = q.content(text, q.WordBuckets())
            p = 1 / (1 + np.exp(-t.odds(1, np.array([t.views[1].raw(q.metadata(*m, style))]))[0]))
            if p <= t.teaches[1][0] or p >= t.teaches[1][1]:
                label = int(p >= t.teaches[1][1])
                counts[label, one] += 1
                totals[label] += 1
        told = priors["quality"][0]
        at = np.flatnonzero(told)
        want = q.PRIOR_SCALE * (np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2)))
        assert len(at) and min(totals) and np.allclose(told[at], np.clip(want[at], -q.PRIOR_MOST, q.PRIOR_MOST), atol=1e-6)


def test_all_labelled_rows_teach(spark, monkeypatch):
    """more labelled rows than a part holds are all fitted or held out, and parts put together classify like one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, y int"
    docs = spark.createDataFrame(_two_views(1500, 4, False), schema)
    labels = docs.select("doc_id", F.col("y").alias("quality"), F.lit(0).alias("toxic"))
    rows, truth = q.features(docs), {r.doc_id: r.y for r in docs.collect()}
    groups = len({(*q.sketch(q.content(r.text, q.WordBuckets())[0]), r.y) for r in docs.collect()})
    for size in (10_000, 150):
        monkeypatch.setattr(q, "PART_ROWS", size)
        known = q.Labelled(q.labelled(rows, labels, "doc_id", None))
        assert known.rows == groups == known.fitted + known.held.count() and known.parts.count() == known.fitted
        model = q.QualityModel(known.fit({t: (None, None) for t in q.TARGETS}))
        got = q.classify_features(rows, model).collect()
        assert np.mean([(r.quality > 0.5) == (truth[r.key] == 1) for r in got]) > 0.97


def test_text_models_count_all_rows(spark, monkeypatch):
    """the models are those of all rows, also where they are more than the 4,000 that were taken before and languages more than a task holds."""
    monkeypatch.setattr(lang, "LANGUAGES_HELD", 2)
    rows = [(i, f"text number {i} of a corpus" if i % 2 else f"wort {i} aus dem text", ("en", "de", "fr")[i % 3]) for i in range(4600)]
    df = spark.createDataFrame([*rows, (5000, "12", "xx"), (5001, None, "yy")], "doc_id long, text string, lang string")
    got, want = lang.fit_all(df), lang.fit_texts([r[1] for r in rows], [r[2] for r in rows])
    assert got.languages == want.languages and np.array_equal(got.logp, want.logp)
    assert lang.fit_all(df.where("false")).languages == ()


def test_language_stage_scores_texts_once_in_a_task(spark, docs_of, monkeypatch):
    """A second evaluation takes a second Python worker of each task, which stays in the executor's memory."""
    docs = docs_of(["the cat sat on the mat and the dog too", "el gato y el perro de la casa", None, "12"])
    plans = []
    monkeypatch.setattr(lang, "reliable", lambda df, keep=lang.reliable: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    found = lang.identify(docs, lang.fit_all(docs), declared="lang", host="source").where("accepted")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and [p.count("ArrowEvalPython") for p in plans] == [1] * len(plans)
    assert found.count() >= 1


def test_a_part_is_fitted_in_memory_of_its_useful_codes():
    """Words that no regression may use take no memory beyond their batch, and those in use get the weights of a fit on whole rows."""
    rng = np.random.default_rng(0)
    n, y = 4000, rng.integers(0, 2, 4000)
    one = [np.unique(np.concatenate((rng.integers(1000, q.BUCKETS[0], 500), np.flatnonzero(rng.random(10) < 0.2 + 0.6 * v)))) for v in y]
    rows = pd.DataFrame({"part": 0, "_quality": y, "_toxic": 0, "_weight": 1.0, "one": list(map(q.packed, one)), "two": [q.packed(np.array([3 + v])) for v in y]})
    known, fitters = q.Labelled.__new__(q.Labelled), []

    class Parts:
        def mapInPandas(self, fitter, schema):
            fitters.append(fitter)
            raise InterruptedError

    some = [np.arange(b) < 10 for b in q.BUCKETS]
    known.parts, known.enough, known.telling = Parts(), some, [[x, x] for x in some]
    with pytest.raises(InterruptedError):
        known.fit({t: (None, None) for t in q.TARGETS})
    batches = [rows.iloc[a : a + 500].reset_index(drop=True) for a in range(0, n, 500)]
    tracemalloc.start()
    got = list(fitters[0](iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # whole rows take 90 MB
    owner = np.repeat(np.arange(n), [len(x) for x in one])
    bias, at, moved, seen = q.descend(np.concatenate(one), owner, y.astype(float), np.ones(n), some[0], np.zeros(q.BUCKETS[0]))
    mine = next(x for x in got if (x["target"] == 0).all() and (x["view"] == 0).all())
    assert mine["bucket"].tolist() == [*at, -1] and mine["seen"].tolist() == [*seen, n]
    assert mine["moved"].to_numpy() == pytest.approx(np.append(moved * seen, bias * n))
