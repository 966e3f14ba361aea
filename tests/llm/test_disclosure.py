"""Terms that disclose protected values, held against plain counts."""

import math
import random
from collections import Counter, defaultdict

import regex

from tidegauge.llm import pii
from tidegauge.llm.common import whole_text, write_once
from pyspark.sql import functions as F

VALUE = regex.compile(r"[a-z0-9]+@[a-z0-9.]+[a-z0-9]")
TERM = regex.compile(pii.TERM)
REACH = 48


def corpus(seed=3, people=24, sightings=3, clean=600):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(220)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = [f"Q{chr(97 + i)}xo{chr(97 + (i * 7) % 26)}w" for i in range(people)]
    docs = [f"{say(9)} {n} {say(rng.randint(0, 2))} p{i}@mail.example.org {say(9)}." for i, n in enumerate(names) for _ in range(sightings)]
    docs += [f"{say(12)}, {n} {say(12)}" for n in names[::3]]  # without the value
    first_clean = len(docs)
    docs += [say(rng.randint(8, 30)) for _ in range(clean)]
    docs += [docs[0]] * 5 + [docs[first_clean]] * 5  # copies are no further evidence
    return names, docs


def brute_telling(docs, threshold=0.9, chance=0.05):
    n_t, n_c, n_ct, seen = Counter(), Counter(), Counter(), defaultdict(set)
    for text in docs:
        values = [m.span() for m in VALUE.finditer(text)]
        plain = text
        for a, b in values:
            plain = plain[:a] + " " * (b - a) + plain[b:]
        terms = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer(plain)]
        n_t.update(t for _, _, t in terms)
        for a, b in values:
            value = text[a:b]
            around = (text[max(0, a - REACH):a], text[b:b + REACH])
            for s, e, t in terms:
                if max(0, a - REACH) <= s and e <= a or b <= s and e <= b + REACH:
                    n_c[value] += 1
                    n_ct[value, t] += 1
                    seen[value, t].add(around)
    m = sum(n_t.values())
    n_d = Counter()
    for (value, _), contexts in seen.items():
        n_d[value] += len(contexts)
    out = set()
    for (value, t), contexts in seen.items():
        both, k = min(n_ct[value, t], n_t[t]), len(contexts)
        e = n_t[t] * k / both * n_d[value] / m
        share = math.log(both * m / (n_c[value] * n_t[t])) / math.log(m / n_c[value])
        if k > 1 and k > e and share >= threshold and \
                k - e - k * math.log(k / e) + math.log(len(n_t) * len(n_c)) <= math.log(chance):
            out.add((value, t))
    return out


def test_telling_pairs_equal_plain_counts(spark):
    names, docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    body = whole_text("text")
    based = df.withColumn("mark", pii.base_spans(body)).withColumn("plain", pii._unmarked(body, F.col("mark")))
    mentions = write_once(based.select(F.explode(pii._near(body, F.col("plain"), F.col("mark"), REACH)).alias("x")).select("x.*"), "near")
    found = {(r["entity"].split(":", 1)[1], r["term"]) for r in pii.disclosing_terms(based, mentions, "plain").collect()}
    assert found == brute_telling(docs)


def test_planted_names_are_found_and_clean_texts_stay(spark):
    names, docs = corpus()
    rows = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    mentions = [(i, n) for i, text in enumerate(docs) for n in names if n in text]
    hidden = [n not in rows[i]["sanitised_text"] for i, n in mentions]
    assert sum(hidden) >= 0.9 * len(hidden)
    held = {i for i, _ in mentions}
    assert all(rows[i]["sanitised_text"] == text for i, text in enumerate(docs) if i not in held)


def test_one_sighting_is_never_beyond_chance(spark):
    names, docs = corpus(sightings=1)
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert all(s["rank"] < 4 for r in rows for s in r["spans"])


def test_two_sightings_suffice_in_a_larger_corpus(spark):
    names, docs = corpus(people=3, sightings=2, clean=9000)
    docs = docs[:6] + docs[7:]  # no mention without the value
    assert {t for _, t in brute_telling(docs)} == {n.lower() for n in names}
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert not [n for r in rows for n in names if n in r["sanitised_text"]]
