"""The shared pass over many terms against a pattern a term."""

import random
import re
import time

from pyspark.sql import functions as F

from tidemark.functions import lexicon, rules, text

TERMS = ["PLA", "de la", "e.", "x y z", "中国", "%%%", "a  b", "in-", "", "  ", "é", "ab", "b", "und/oder", "ß"]
SAID = ["The PLA's plan", "plane pla", "de  la", "de\nla", "De　La x", "xy z x  y z", "在中国工人", "100%%%", "a  b a b", "in-out e.", "e.x", None, "", "AB b", "ab2 _b_", "é́ É", "und/oder und / oder", "STRASSE straße"]


def test_equals_a_pattern_a_term(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAID)], "i int, s string")
    kinds = {lexicon.TERM: text.term_hit, lexicon.ALIAS: lambda c, t: text.has_alias(F.lower(F.coalesce(c, F.lit(""))), t), lexicon.PART: lambda c, t: F.size(text.matched_terms(c, [t])) > 0}
    for kind, single in kinds.items():
        found = lexicon.found_terms(F.col("s"), [(kind, t) for t in TERMS])
        hits = F.array(*(single(F.col("s"), t) for t in TERMS))
        for r in df.select("s", found.alias("f"), hits.alias("h")).collect():
            assert r.f == [i for i, hit in enumerate(r.h) if hit], (kind, r.s)


def test_cost_is_flat_in_the_number_of_terms(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    texts = [" ".join(word() for _ in range(200)) for _ in range(300)]
    few, many = ([(lexicon.TERM, word()) for _ in range(n)] for n in (7, 700))

    def seconds(terms):
        plan = lexicon._Plan(tuple(terms))
        start = time.process_time()
        for t in texts:
            plan.found(t)
        return time.process_time() - start

    assert seconds(many) < 8 * max(seconds(few), 0.005)


def test_large_configuration(spark):
    """Profiles, taxonomy and post rules with several hundred terms equal a plain reading."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 4)))
    profiles = {f"P{i} {word()}": {"aliases": [word() for _ in range(3)], "entities": [word() for _ in range(4)], "interests": [word()] * 2} for i in range(70)}
    taxonomy = {f"k{i}": {"exposure_weight": 50 + i % 3, "terms": [word() for _ in range(20)]} for i in range(9)}
    rows = [(i, " ".join(word() for _ in range(30)), rng.choice([*profiles, "", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s string, c string")
    stands = lambda t, s: len(t) >= 2 and re.search(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])", s) is not None
    for r in df.select("s", "c", rules.match_profiles(F.col("s"), F.col("c"), profiles).alias("m"), rules.risk_taxonomy(F.col("s"), taxonomy).alias("t")).collect():
        named, things = [r.c] if r.c in profiles else [], []
        for name, spec in profiles.items():
            own = [e for e in spec["entities"] if len(e) >= 3 and stands(e, r.s)]
            things += [e for e in own if e not in things]
            if name not in named and (own or any(stands(a, r.s) for a in [name, *spec["aliases"]])):
                named.append(name)
        context = " | ".join(f"{rules.CONTEXT[0]}{n}; {rules.CONTEXT[1]}{', '.join(profiles[n]['interests'])}; {rules.CONTEXT[2]}{', '.join(profiles[n]['entities'])}" for n in named[:4])
        assert (r.m.profiles, r.m.entities, r.m.context) == (named[:8], things[:15], context)
        hits = {k: [t for t in spec["terms"] if stands(t, r.s) or (len(t) < 2 and re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", r.s))] for k, spec in taxonomy.items()}
        want = sorted((k for k in taxonomy if hits[k]), key=lambda k: (-taxonomy[k]["exposure_weight"], -min(12, len(hits[k]))))
        assert [(x.key, x.terms) for x in r.t] == [(k, hits[k][:12]) for k in want]


def test_reasons(spark):
    profiles = {"Zambia": {"aliases": [], "entities": ["copper belt"], "interests": ["mines"]}}
    rows = [("Beijing says", ""), ("copper belt strike", ""), ("a strike", "Zambia"), ("a strike", "China"), ("nothing", "")]
    df = spark.createDataFrame(rows, "s string, c string")
    m = rules.match_profiles(F.col("s"), F.col("c"), profiles)
    got = [r.d.reason for r in df.select(rules.heuristic_decision(F.col("s"), F.col("c"), m).alias("d")).collect()]
    context = "事件关联地区=Zambia; 中国关联利益=mines; 中国关联实体/项目=copper belt"
    assert got == [rules.REASONS["direct"], "命中中国海外关联企业/项目；" + context, rules.REASONS["profile"].replace("{}", context), rules.REASONS["home"], rules.REASONS["none"]]
