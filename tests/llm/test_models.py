from __future__ import annotations

import hashlib
import math

import pytest

from evalfold.llm import license_scan as L
from evalfold.llm import quality as Q
from evalfold.llm import secret_scan as X

from . import brute
from .conftest import rows

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.resample(docs, labels.filter(F.xxhash64("doc_id") % 2 == 0))
    seen = got.join(labels.filter(F.xxhash64("doc_id") % 2 != 0), "doc_id").toPandas()
    assert (seen[seen.quality == 1].kept).mean() >= 0.98 and (~seen[seen.quality == 0].kept).mean() >= 0.9


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (6, None), (9, 7)], "doc_id long, quality int")
    assert Q.resample(docs, labels, carry=["doc_id", "text", "lang"]).count() == len(rows())
    assert Q.resample(docs, labels.limit(0)).filter("NOT kept OR log_weight <> 0").count() == 0
    assert Q.resample(no_docs, labels).count() == 0


def test_quality_counts_every_occurrence(spark):
    docs = spark.createDataFrame([(1, "one two " * 50), (2, "three " * 30), (3, "four")], "doc_id long, text string")
    raw, target = Q.train(docs, frozenset([1]))
    assert (raw.sum(), target.sum(), raw.max()) == (100 + 99 + 30 + 29 + 1, 100 + 99, 50)
    # Without its own text no target is left, so the only target document says nothing for itself.
    assert Q.log_weights(docs, raw, target, frozenset([1])).filter("doc_id = 1").first().log_weight == 0


def test_quality_carries_columns_of_any_name(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    got = Q.resample(docs.withColumns({"id": F.col("doc_id") * 2, "q": F.lit("own"), "at": F.lit(1)}), labels, carry=["id", "q", "text", "at"])
    assert got.columns == ["id", "q", "text", "at", "log_weight", "gumbel_key", "kept"]
    assert got.count() == len(rows()) and got.filter("q <> 'own'").count() == 0


def test_weights_and_noise_equal_a_plain_version(spark):
    """The models by dictionaries of buckets, one text at a time, and the noise from the id's hash."""
    import re
    from collections import Counter

    import numpy as np
    import xxhash
    from pyspark.sql import functions as F

    from evalfold.llm.words import Words, mix

    texts = {i: t for i, t in enumerate(["", "good good text, of many words", "of many words of many words!", "bad bad bad bad bad", "x " * 300 + "end", "Ünï ¿text? 12 12 12", "good text"])}
    chosen = frozenset([1, 6])

    def word_hash(token: str) -> int:
        b = np.frombuffer(token.encode(), np.uint8)
        return int(Words(b, np.array([0, len(b)]), np.ones(256, np.uint8)).hashes(np.array([0]))[0])

    def counts(text: str) -> Counter:
        tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        h, out, run = [word_hash(t) for t in tokens], Counter(), 0
        out.update(x % Q.HASHED for x in h)
        for a, b in zip(h, h[1:]):
            run = run + 1 if a == b else 0
            pair = int(mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], dtype=np.uint64))[0]) % Q.HASHED
            out[Q.HASHED + min(run, Q.RUNS) - 1 if a == b else pair] += 1
        return out

    own = {i: counts(t) for i, t in texts.items()}
    raw, target = (sum((own[i] for i in ids), Counter()) for ids in (texts, chosen))

    def weight(i: int) -> float:
        mine, n = own[i], sum(own[i].values())
        share = max(sum(target.values()) - n * (i in chosen), 0) / max(sum(raw.values()) - n, 1)
        total = sum(k * math.log((target[b] - k * (i in chosen) + Q.PRIOR) / ((raw[b] - k) * share + Q.PRIOR)) for b, k in mine.items())
        return total * min(n, Q.LENGTH) / max(n, 1)

    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in chosen)) for i in texts], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.resample(docs, labels).collect()}
    for i in texts:
        h = xxhash.xxh64_intdigest(b"gumbel", seed=xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42))
        noise = -math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))
        assert math.isclose(got[i].log_weight, weight(i), abs_tol=1e-9) and math.isclose(got[i].gumbel_key, weight(i) + noise, abs_tol=1e-9)
    cutoff = Q.fit_cutoff(np.array([weight(i) for i in chosen]), np.array([weight(i) for i in texts if i not in chosen]))
    k = sum(weight(i) >= cutoff for i in texts)
    assert {i for i in texts if got[i].kept} == set(sorted(texts, key=lambda i: -got[i].gumbel_key)[:k])


@pytest.mark.parametrize("k", [0, 1, 2, 500, 999, 1000, 2000])
def test_kth_largest_is_exact(spark, k):
    from pyspark.sql import functions as F

    keys = spark.range(1000).select(F.pow(F.xxhash64("id").cast("double") / 1e18, 3).alias("key"))
    values = sorted((r.key for r in keys.collect()), reverse=True)
    want = math.inf if k < 1 else -math.inf if k >= 1000 else values[k - 1]
    assert Q.kth_largest(keys, "key", k) == want


def test_kth_largest_with_ties(spark):
    keys = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 3 + [(0.5,)] * 7, "key double")
    assert [Q.kth_largest(keys, "key", k) for k in (1, 3, 4, 53, 54)] == [2.0, 2.0, 1.0, 1.0, 0.5]


@pytest.fixture(scope="module")
def licenses(spark):
    return L.train(spark, L.labelled_paragraphs())


def test_licenses_on_held_out_sentences(spark):
    """A classifier that never saw every fourth paragraph of the longer families is tried on those, and on unseen ordinary text."""
    shown = {f: [x for i, x in enumerate(s) if len(s) < 5 or i % 4 != 3] for f, s in L.TEMPLATES.items()}
    held = [(x, f) for f, s in L.TEMPLATES.items() for x in s if x not in shown[f]]
    model = L.train(spark, L.labelled_paragraphs(templates=shown))
    p = model.probabilities(*L.features(*L._run([x.encode() for x, _ in held])), len(held))
    right = [(model.names[int(q.argmax())] == f, 1 - q[0] >= model.least) for q, (_, f) in zip(p, held)]
    assert len(held) >= 8 and sum(a and b for a, b in right) / len(held) >= 0.5  # they share few words with what was shown
    assert sum(b for _, b in right) / len(held) >= 0.7  # at least known not to be ordinary
    unknown = [x for x, f in L.labelled_paragraphs(60, seed=77) if f == L.UNKNOWN]
    q = model.probabilities(*L.features(*L._run([x.encode() for x in unknown])), len(unknown))
    assert (1 - q[:, 0] >= model.least).mean() <= 0.02


def test_pieces_of_notices_are_told_apart(licenses):
    held = L.labelled_paragraphs(40, seed=77)
    p = licenses.probabilities(*L.features(*L._run([x.encode() for x, _ in held])), len(held))
    assert sum(licenses.names[int(q.argmax())] == f for q, (_, f) in zip(p, held)) / len(held) >= 0.96


def test_license_lines_are_found(spark, docs, no_docs, licenses):
    lines = ["The river ran on.", "Licensed under the Apache License, Version 2.0.", "", "Ünï word, then: Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "The MIT campus is large."]
    found = L.find_licenses(spark.createDataFrame([(0, "ends in a break\n"), (1, "\n".join(lines)), (2, None), (3, "\n\n")], "doc_id long, text string").coalesce(1), licenses).orderBy("doc_id").collect()
    assert [(x.family, x.line, x.last_line) for x in found[1].licenses] == [("Apache-2.0", 1, 1), ("MIT", 3, 3), ("GPL", 4, 4)] and [r.n_paragraphs for r in found] == [1, 2, 0, 0]
    assert ["\n".join(lines)[x.start : x.end] for x in found[1].licenses] == [lines[1], lines[3], lines[4]]
    assert not any(r.licenses for r in found if r.doc_id != 1)
    edge = L.find_licenses(docs, licenses).filter("size(licenses) > 0").collect()
    assert [x.family for r in edge for x in r.licenses] == ["MIT"]
    assert L.find_licenses(no_docs, licenses).count() == 0


def test_wrapped_notices_are_one_span(spark, licenses):
    import textwrap

    texts, want = [], []
    for family, sentences in L.TEMPLATES.items():
        for s in sentences:
            if len(s) > 150:
                wrapped = textwrap.wrap(s, 60)
                texts.append("\n".join(["# Ordinary words of a file about nothing.", "#", *(f"# {x}" for x in wrapped), "", "def work(a, b):", "    return a + b"]))
                want.append((family, 2, 1 + len(wrapped)))
    got = L.find_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), licenses).orderBy("doc_id").collect()
    spans = [[(x.family, x.line, x.last_line) for x in r.licenses] for r in got]
    assert len(want) > 20 and sum(s == [x] for s, x in zip(spans, want)) >= 0.85 * len(want)


def test_licenses_equal_a_plain_version(spark, licenses):
    import random

    import numpy as np

    from evalfold.llm.words import Words, mix

    templates = [(f, {*zip(brute.words(s), brute.words(s)[1:])}) for f, s in ((f, s) for f, own in L.TEMPLATES.items() for s in own)]

    def hashed(word):
        b = np.frombuffer(word.encode(), np.uint8)
        return int(Words(b, np.array([0, len(b)]), np.ones(256, bool)).hashes(np.array([0]))[0])

    def judge(words):
        """(family, probability, pairs of the confirming templates) or None."""
        own = {*zip(words, words[1:])}
        agree = [(f, t) for f, t in templates if own & t and 100 * len(own & t) >= L.CONFIRM * min(len(own), len(t))]
        buckets = set()
        for n in range(1, L.LONGEST + 1):
            for i in range(len(words) - n + 1):
                h = hashed(words[i])
                for x in words[i + 1 : i + n]:
                    h = int(mix(np.array([(h * 0x9E3779B97F4A7C15 + hashed(x)) % 2**64], dtype=np.uint64))[0])
                buckets.add(h % L.BUCKETS)
        logits = licenses.intercepts + sum(licenses.coefficients[b] for b in sorted(buckets))
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        best = int(p[1:].argmax()) + 1
        held = [t for f, t in agree if f == licenses.names[best]]
        return (licenses.names[best], float(p.max()), set().union(*held)) if held and 1 - p[0] >= licenses.least and p[best] > p[0] else None

    def plain(text):
        lines = [brute.words(x) for x in (text or "").split("\n")]
        runs, out = [], []
        for i, x in enumerate(lines):
            if x:
                runs.append([*runs.pop(), i] if runs and runs[-1][-1] == i - 1 else [i])
        for run in runs:
            for unit in [run, *([i] for i in run if len(run) > 1)]:
                words = [x for i in unit for x in lines[i]]
                if found := judge(words):
                    a, b = unit[0], unit[-1]
                    if a < b:
                        inside = [any(p in found[2] for p in zip(words[max(0, j - 1) : j + 1], words[max(0, j - 1) + 1 : j + 2])) for j in range(len(words))]
                        at, part = 0, []
                        for i in unit:
                            if 100 * sum(inside[at : at + len(lines[i])]) >= L.PART * len(lines[i]):
                                part.append(i)
                            at += len(lines[i])
                        a, b = (part[0], part[-1]) if part else (a, b)
                    out.append((a, b, found[0]))
        merged = []
        for f in sorted(out, key=lambda f: (f[2], f[0], f[1])):
            if merged and merged[-1][2] == f[2] and f[0] <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], f[1]), f[2])
            else:
                merged.append(f)
        return len(runs), sorted(merged)

    r = random.Random(12)
    every = [w for s in L.TEMPLATES.values() for x in s for w in [x]]

    def line():
        kind = r.random()
        if kind < 0.3:
            return r.choice(["", " -- ", "la la la", "one"])
        words = r.choice(every).split()
        a = r.randrange(len(words))
        return " ".join(words[a : a + r.randrange(3, 25)]) if kind < 0.7 else L.labelled_paragraphs(1, r.randrange(99))[-r.randrange(1, 8)][0]

    texts = [None, "", *("\n".join(line() for _ in range(r.randrange(1, 8))) for _ in range(80))]
    got = L.find_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), licenses).collect()
    assert len(got) == len(texts) and sum(len(x.licenses) for x in got) > 40
    for x in got:
        assert (x.n_paragraphs, [(n.line, n.last_line, n.family) for n in x.licenses]) == plain(texts[x.doc_id])


@pytest.fixture(scope="module")
def markov(spark):
    return X.train(X.labelled_samples(spark))


def test_base_secrets_equal_brute_force(docs, no_docs, markov):
    got = X.find_secrets(docs, *markov).select("doc_id", X.render(X.F.col("base")).alias("spans")).collect()
    text = {i: t for i, t, *_ in rows()}
    assert len(got) == len(rows())
    for r in got:
        assert r.spans == ",".join(f"{X.KINDS[k]}:{a}:{b}" for a, k, b in brute.secrets(text[r.doc_id]))
    assert X.find_secrets(no_docs, *markov).count() == 0


def test_positions_of_many_matches(spark, markov):
    text = "é ".join(["deadbeef" * 2, "x", "😀"] * 400)
    got = X.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), *markov).first()
    assert [(s.start, s.kind, s.end) for s in got.base] == brute.secrets(text)


def test_random_strings_are_added_and_identifiers_not(spark, markov):
    secret = [hashlib.sha512(str(i).encode()).hexdigest() for i in range(40)]
    import base64

    secret = [base64.b64encode(bytes.fromhex(s)).decode().rstrip("=")[:32] for s in secret]
    plain = ["read_user_index_from_cache", "loadConfigurationManagerFactory", "internationalisation-of-words", "MAX_NUMBER_OF_OPEN_FILES_LEFT", "path/to/the/configuration/file", "unquestionablyverylongword"]
    rows_ = [*enumerate([f"here {s} there" for s in secret + plain])]
    got = {r.doc_id: len(r.added) for r in X.find_secrets(spark.createDataFrame(rows_, "doc_id long, text string"), *markov).collect()}
    assert sum(got[i] for i in range(40)) >= 38 and sum(got[i] for i in range(40, len(rows_))) == 0


def test_short_random_strings_are_added_and_short_words_not(spark, markov):
    import base64

    short = X.train_short(X.short_samples(spark, 2000))
    secret = [base64.b64encode(hashlib.sha512(str(i).encode()).digest()).decode()[: 12 + i % 8] for i in range(80)]
    plain = ["configuration", "internationally", "getUserIndex", "max_file_count", "Versicherungen", "2024-01-02T10", "path/to/file", "123456789012", "responsabilidad", "laouauxeuxeux", "ONANLYSHBLEONND", "taasosllgaas", "MAX_OPEN_FILES"]
    rows_ = [*enumerate([f"here {s} there" for s in secret + plain])]
    got = {r.doc_id: [(s.start, s.end) for s in r.added] for r in X.find_secrets(spark.createDataFrame(rows_, "doc_id long, text string"), *markov, short).collect()}
    assert sum(got[i] == [(5, 5 + len(secret[i]))] for i in range(80)) >= 72 and not any(got[i] for i in range(80, len(rows_)))


def test_added_spans_equal_brute_force(spark, markov):
    """Scores by a dictionary of transitions, and containment by trying every base span."""
    import random
    import re

    table, threshold = markov
    short = X.train_short(X.short_samples(spark, 500))
    r = random.Random(8)
    part = lambda: r.choice([
        "".join(r.choice(X.CHARS[:62]) for _ in range(r.randrange(8, 50))), "deadbeef" * r.randrange(1, 4), "token=", 'password: "', " ", "\n", "é", "read_user_index_from_cache", "AKIA" + "Q7" * r.randrange(5, 12), "configuration",
    ])
    texts = ["".join(part() for _ in range(r.randrange(1, 60))) for _ in range(60)]

    def score(token, ratios):
        return sum(float(f"{ratios[ord(a) * 128 + ord(b)]:.5f}") for a, b in zip(token, token[1:])) / (len(token) - 1)

    def want(text):
        base = brute.secrets(text)
        for m in re.finditer(X.TOKEN, text):
            t = m[0]
            passes = score(t, table) > threshold if len(t) >= X.LONG else score(t, short[0]) > short[1][len(t) - X.LEAST["markov"]]
            if passes and not any(a <= m.start() and m.end() <= b for a, _, b in base):
                yield m.start(), 3, m.end()

    got = X.find_secrets(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), table, threshold, short).collect()
    for row in got:
        assert [(s.start, s.kind, s.end) for s in row.added] == [*want(texts[row.doc_id])]
    assert sum(len(row.added) for row in got) > 50


def test_markov_training_equals_plain_counts(spark):
    from collections import Counter

    samples = [(r.token, r.random) for r in X.labelled_samples(spark, 300).collect()]
    pairs = {label: Counter(t[i : i + 2] for t, x in samples if x == label for i in range(len(t) - 1)) for label in (True, False)}
    table, _ = X.train(spark.createDataFrame(samples, "token string, random boolean"))
    known = {label: Counter() for label in pairs}
    for label, c in pairs.items():
        known[label].update({p: n for p, n in c.items() if p[0] in X.CHARS and p[1] in X.CHARS})
    for a in X.CHARS:
        row = {label: sum(known[label][a + b] + 1 for b in X.CHARS) for label in known}
        for b in X.CHARS:
            assert math.isclose(table[ord(a) * 128 + ord(b)], math.log((known[True][a + b] + 1) / row[True] / ((known[False][a + b] + 1) / row[False])), abs_tol=1e-12)


def test_a_text_of_many_spans_takes_seconds(spark, markov):
    import time

    text = " ".join(f'token="{hashlib.sha512(str(i).encode()).hexdigest()[:20]}" {hashlib.sha1(str(i).encode()).hexdigest().upper()[:7]}qX7vT2mK9pL4sR8wZ1bN6' for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    got = X.find_secrets(docs, *markov).first()
    assert len(got.base) == 8000 and len(got.added) > 3500 and time.perf_counter() - start < 60


def test_random_token_around_a_base_span_is_added_whole(spark, markov):
    token = "qX7vT2mK9pL4" + "deadbeef01234567" + "sR8wZ1bN6cJ3"
    got = X.find_secrets(spark.createDataFrame([(1, f"a {token} b"), (2, f'password = "{token}"')], "doc_id long, text string"), *markov).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in got[0].base] == [(13, 30)] and [(s.start, s.end) for s in got[0].added] == [(2, 42)]
    assert not got[1].added


def test_training_without_samples(spark):
    table, threshold = X.train(spark.createDataFrame([], "token string, random boolean"))
    assert not any(table) and threshold == math.inf
