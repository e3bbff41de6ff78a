"""Ordered and additive decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .lexicon import ALIAS, PART, TERM, found_terms, picked
from .text import let


def _add(c: Column, n: int) -> Column:
    return F.when(c, n).otherwise(0)


#: Why a decision was made; {} stands for the context of the profiles.
REASONS = {
    "direct": "内容直接出现中国、中国机构/企业/人员、台湾台海或其他直接涉华实体",
    "home": "事件发生于中国大陆/香港/台湾，且属于政治、外交、经济、产业、安全或社会层面的重大变化",
    "entity": "命中中国海外关联企业/项目；{}",
    "profile": "发生在存在中国重要利益暴露的国家/地区，且属于重大政治、经济、产业或安全变化；{}",
    "none": "未发现足够的直接、间接或重大潜在涉华关联",
    "post entity": "命中中国海外关联企业/项目，并出现异常事件信号；{}",
    "post anchor": "直接涉华对象与异常事件/政策动作同时出现，具备苗头价值",
    "post profile": "重大事件发生在中国利益暴露区域，并涉及战略资产/供应链；{}",
    "post none": "仅出现泛涉华词或消费/生活内容，未发现值得预警的异常事件",
}
#: How the context of a profile names its region, interests and entities.
CONTEXT = ("事件关联地区=", "中国关联利益=", "中国关联实体/项目=")


def _reason(name: str, context: Column | None = None) -> Column:
    said = REASONS[name]
    return F.concat(F.lit(said[:-2]), context) if said.endswith("{}") else F.lit(said)


def relevance_decision(text: Column, anchors: list[str], events: list[str], strategic: list[str], noise: list[str], severity: Column, entities: Column, profiles: Column, context: Column | None = None) -> Column:
    """What the rules for social posts say of a text, as a struct.

    Posts are accepted that name an event beside a known entity or an anchor and score 55, or an event and a
    strategic asset in a profiled country and score 60. entities, profiles and context: what match_profiles found. The
    terms of all four lists count anywhere in the text and are found in one pass.
    """
    lists = {n: [t for t in dict.fromkeys(map(str, w)) if t.strip()] for n, w in {"anchors": anchors, "events": events, "strategic": strategic, "noise": noise}.items()}
    places = found_terms(text, [(PART, t) for terms in lists.values() for t in terms])
    context = F.lit("") if context is None else context

    def told(held: Column) -> Column:
        found, at = {}, 0
        for name, terms in lists.items():
            found[name] = picked(held, terms, at)
            at += len(terms)
        some = F.struct(*(c.alias(n) for n, c in found.items()), entities.alias("entities"), profiles.alias("profiles"), severity.alias("severity"), context.alias("context"))
        return let(some, _relevance)

    return let(places, told)


def _relevance(f: Column) -> Column:
    has = {n: F.size(f[n]) > 0 for n in ("anchors", "events", "strategic", "noise", "entities", "profiles")}
    score = _add(has["anchors"], 38) + _add(has["entities"], 28) + _add(has["events"], 34) + _add(has["strategic"], 14)
    score += F.when(f["severity"] >= 75, 10).when(f["severity"] >= 50, 5).otherwise(0)
    score += F.when(has["noise"] & ~has["events"], -48).when(has["noise"], -15).otherwise(0)
    score += _add(has["anchors"] & ~has["entities"] & ~has["events"], -25) + _add(~has["anchors"] & ~has["entities"], -20)
    by_entity, by_anchor = has["entities"] & has["events"], has["anchors"] & has["events"]

    def told(score: Column) -> Column:
        by_profile = has["profiles"] & has["events"] & has["strategic"] & (score >= 60)
        relation = F.when(by_entity, F.when(score >= 55, "indirect").otherwise("unrelated")).when(by_anchor, F.when(score >= 55, "direct").otherwise("unrelated")).when(by_profile, "potential").otherwise("unrelated")
        reason = F.when(by_entity, _reason("post entity", f["context"])).when(by_anchor, _reason("post anchor")).when(by_profile, _reason("post profile", f["context"])).otherwise(_reason("post none"))
        accepted = relation != "unrelated"
        sure = F.when(accepted & (has["anchors"] | has["entities"]) & has["events"], 72).when(accepted, 55).otherwise(70)
        lists = [F.slice(f[n], 1, 12).alias(n) for n in ("anchors", "events", "strategic", "noise")]
        return F.struct(score.alias("score"), accepted.alias("accepted"), relation.alias("relation"), sure.alias("confidence"), *lists, F.slice(f["entities"], 1, 12).alias("entities"), F.slice(f["profiles"], 1, 8).alias("profiles"), reason.alias("reason"))

    return let(F.greatest(F.lit(0), F.least(F.lit(100), score)), told)


def match_profiles(text: Column, country: Column, profiles: dict[str, dict[str, list[str]]]) -> Column:
    """Struct of the profiles (8 at most) and entities (15 at most) that a text and its country match, and their context.

    profiles: name -> aliases, entities and interests. The profile of the country comes first, then those with an alias or an
    entity in the text, in their order. The context tells of the first four, with 8 interests and 10 entities each. All
    aliases and entities are found in one pass.
    """
    empty = F.array().cast("array<string>")
    names = list(profiles)
    terms, owner, things = [], [], []
    for i, (name, spec) in enumerate(profiles.items()):
        entities = [e for e in (str(e).strip() for e in spec.get("entities") or []) if len(e) >= 3]
        for term, thing in [*((a, None) for a in [name, *map(str, spec.get("aliases") or [])]), *((e, e) for e in entities)]:
            terms.append((ALIAS, term))
            owner.append(i)
            things.append(thing)
    if not names:
        return F.struct(empty.alias("profiles"), empty.alias("entities"), F.lit("").alias("context"))
    homes: dict[str, int] = {}
    for i, (name, spec) in enumerate(profiles.items()):
        for alias in [name, *map(str, spec.get("aliases") or [])]:
            homes.setdefault(alias.lower(), i)
    home = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    at_home = F.when(home != "", F.get(F.array(*map(F.lit, homes.values())), (F.array_position(F.array(*map(F.lit, homes)), home) - 1).cast("int")))
    lit = lambda values: F.array(*map(F.lit, values))

    def context(name: str, spec: dict) -> str:
        parts = [CONTEXT[0] + name]
        for head, key, most in ((CONTEXT[1], "interests", 8), (CONTEXT[2], "entities", 10)):
            if spec.get(key):
                parts.append(head + ", ".join(map(str, spec[key][:most])))
        return "; ".join(parts)

    contexts = lit([context(n, s) for n, s in profiles.items()])

    def told(found: Column) -> Column:
        hit = F.array_sort(F.array_distinct(F.transform(found, lambda i: F.get(lit(owner), i))))
        order = F.array_distinct(F.filter(F.concat(F.array(at_home), hit), lambda p: p.isNotNull()))
        named = F.filter(F.transform(found, lambda i: F.get(lit(things), i)), lambda e: e.isNotNull())
        spoken = let(order, lambda o: F.struct(F.transform(F.slice(o, 1, 8), lambda p: F.get(lit(names), p)).alias("p"), F.array_join(F.transform(F.slice(o, 1, 4), lambda p: F.get(contexts, p)), " | ").alias("c")))
        return let(spoken, lambda x: F.struct(x["p"].alias("profiles"), F.slice(F.array_distinct(named.cast("array<string>")), 1, 15).alias("entities"), x["c"].alias("context")))

    return let(found_terms(text, terms), told)


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")


def judged(text: Column, country: Column, matched: Column, social: bool = False, direct: str = fixed.DIRECT, major: str = fixed.MAJOR, leisure: str = fixed.LEISURE) -> Column:
    """Struct of direct, candidate, relation, confidence, entities and reason of a text: each pattern is tried once at most.

    candidate: whether a text is worth a closer look, by direct terms, a known entity, or a grave event at home or in a
    profiled country. The rest is the first rule of the cascade that applies. matched: what match_profiles found.
    """
    sure = lambda news, post: F.lit(post if social else news)
    none = F.array().cast("array<string>")
    at_home = F.trim(F.coalesce(country, F.lit(""))).isin(list(fixed.HOME_COUNTRIES))

    def told(f: Column) -> Column:
        m = f["m"]
        special = F.exists(m["profiles"], lambda p: ~F.lower(p).isin(list(fixed.GENERIC_PROFILES)))
        known = F.size(m["entities"]) > 0
        say = lambda relation, n, things, reason: F.struct(F.lit(relation).alias("relation"), n.alias("confidence"), things.alias("entities"), reason.alias("reason"))
        first = (
            F.when(f["direct"], say("direct", sure(94, 62), none, _reason("direct")))
            .when(at_home & f["grave"], say("direct", sure(88, 58), none, _reason("home")))
            .when(known, say("indirect", sure(84, 58), m["entities"], _reason("entity", m["context"])))
            .when(special & f["grave"], say("potential", sure(62, 45), none, _reason("profile", m["context"])))
            .otherwise(say("unrelated", F.lit(55), none, _reason("none")))
        )
        candidate = f["direct"] | known | (f["grave"] & (at_home | (F.size(m["profiles"]) > 0)))
        return let(first, lambda d: F.struct(f["direct"].alias("direct"), candidate.alias("candidate"), *(d[n].alias(n) for n in ("relation", "confidence", "entities", "reason"))))

    return let(F.struct(matched.alias("m"), _matches(text, direct).alias("direct"), (_matches(text, major) & ~_matches(text, leisure)).alias("grave")), told)


def heuristic_decision(text: Column, country: Column, matched: Column, social: bool = False, direct: str = fixed.DIRECT, major: str = fixed.MAJOR, leisure: str = fixed.LEISURE) -> Column:
    """Struct of relation, confidence, entities and reason: the first rule of the cascade that applies; see judged()."""
    return let(judged(text, country, matched, social, direct, major, leisure), lambda d: F.struct(*(d[n].alias(n) for n in ("relation", "confidence", "entities", "reason"))))


def is_candidate(text: Column, country: Column, matched: Column, direct: str = fixed.DIRECT, major: str = fixed.MAJOR, leisure: str = fixed.LEISURE) -> Column:
    """Whether a text is worth a closer look; see judged()."""
    return judged(text, country, matched, False, direct, major, leisure)["candidate"]


def risk_taxonomy(text: Column, taxonomy: dict[str, dict]) -> Column:
    """The risk categories with a term in the text, as structs, by weight and number of terms, largest first.

    taxonomy: key -> label_zh, label_en, exposure_weight and terms; all terms are found in one pass.
    """
    terms = {key: list(map(str, spec.get("terms") or [])) for key, spec in taxonomy.items()}

    def category(i: int, key: str, spec: dict):
        return lambda hits: F.struct(
            F.lit(int(spec.get("exposure_weight") or 60)).alias("weight"), F.least(F.size(hits), F.lit(12)).alias("n"), F.lit(-i).alias("turn"), F.lit(key).alias("key"),
            F.lit(spec.get("label_zh") or key).alias("label_zh"), F.lit(spec.get("label_en") or key).alias("label_en"), F.slice(hits, 1, 12).alias("terms"),
        )

    def told(found: Column) -> Column:
        made, at = [], 0
        for i, (key, spec) in enumerate(taxonomy.items()):
            made.append(let(picked(found, terms[key], at), category(i, key, spec)))
            at += len(terms[key])
        return F.sort_array(F.filter(F.array(*made), lambda c: c["n"] > 0), asc=False)

    return let(found_terms(text, [(TERM, t) for held in terms.values() for t in held]), told)


def source_tier(name: Column, kind: Column, tiers: list[tuple[int, str]], other: int = 3) -> Column:
    """1 for official sources, else the first tier with a pattern in the name, else by kind."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    out = F.when(kind == "think_tank", 3).when(kind == "social", 4).otherwise(other)
    for tier, pattern in sorted(tiers, key=lambda t: t[0], reverse=True):
        out = F.when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(pattern.lower())), tier).otherwise(out)
    return F.when(kind == "official", 1).otherwise(out)


def site_tier(name: Column, tiers: list[tuple[int, str]], other: int = 3) -> Column:
    """The tier shown beside a source: by its name alone, tiers 1 to 3."""
    return source_tier(name, F.lit(""), [t for t in tiers if t[0] <= 3], other)


def lifecycle(resolved: Column, is_new: Column, age: Column, momentum: Column, hit: Column, worse: Column, new_sources: Column, before: Column, stale: Column) -> Column:
    """The first state that applies; age and stale are hours, before is the last run's state."""
    rising = (momentum >= 55) | hit | worse | (new_sources >= 2)
    return (
        F.when(resolved, "resolved").when(is_new & (age <= 36), "emerging").when(rising, "escalating")
        .when((before == "emerging") & (age <= 24) & (stale <= 24), "emerging").when((before == "escalating") & (stale <= 12) & (momentum > 20), "escalating")
        .when((stale >= 36) | (momentum <= 20), "stabilizing").when(age <= 24, "emerging").otherwise("stabilizing")
    )


def evidence_status(news: Column, social: Column, families: Column, official: Column) -> Column:
    """A word for what an event rests on."""
    return F.when((social > 0) & (news == 0), F.when(families == 1, "苗头").otherwise("多源苗头")).when(official, "官方信号").when((news > 0) & (social > 0), "持续发展").otherwise("报道中")


#: What is said of a lifecycle, and of other reasons to look now; {} stands for a number.
_WHY = {
    "zh": {"emerging": "近期首次进入事件池", "escalating": "正在升级或扩散", "stabilizing": "近期新增证据有限，进入趋稳观察", "resolved": "出现解决/恢复迹象", "new": "新增{}条独立信息链", "many": "已有{}条独立信息链", "official": "本轮首次出现官方证据", "scores": "新颖度{} / 动量{}", "risk": "{}信号", "none": "涉华异常信号"},
    "en": {
        "emerging": "newly entered the event pool", "escalating": "is escalating or spreading", "stabilizing": "has limited new evidence and is stabilizing", "resolved": "shows signs of resolution or recovery",
        "new": "{} new independent source chain(s)", "many": "{} independent source chains", "official": "official evidence appeared for the first time", "scores": "novelty {} / momentum {}", "risk": "{} signal", "none": "China-related anomaly",
    },
}


def why_now(lang: str, state: Column, risk: Column, new_sources: Column, sources: Column, official_added: Column, novelty: Column, momentum: Column) -> Column:
    """A sentence in zh or en on why an event is worth a look now."""
    said = _WHY[lang]
    fill = lambda form, *cs: F.concat(*(x for pair in zip(map(F.lit, form.split("{}")), [*(c.cast("string") for c in cs), F.lit("")]) for x in pair))
    life = F.create_map(*(F.lit(x) for k in ("emerging", "escalating", "stabilizing", "resolved") for x in (k, said[k])))
    parts = [
        F.when(F.coalesce(risk, F.lit("")) == "", said["none"]).otherwise(fill(said["risk"], risk)), F.try_element_at(life, state),
        F.when(new_sources > 0, fill(said["new"], new_sources)).when(sources >= 2, fill(said["many"], sources)), F.when(official_added, said["official"]), fill(said["scores"], novelty, momentum),
    ]
    joint, end = ("；", "。") if lang == "zh" else ("; ", ".")
    return F.concat(F.concat_ws(joint, *parts), F.lit(end))


#: The English reason of an event by the relation of its first evidence.
_REASONS = {
    "direct": "Direct China-related signal involving China, Chinese entities, personnel, Taiwan, or other explicit China-linked subjects.",
    "indirect": "Indirect China-related signal linked to a known Chinese overseas company, project, asset, or supply-chain exposure.",
    "": "Potential China-related signal: a material political, economic, industrial, or security change in an area with identified Chinese interests.",
}


def english_reason(relation: Column, countries: Column, entities: Column) -> Column:
    """The English reason where no translation is at hand."""
    base = F.when(relation == "direct", _REASONS["direct"]).when(relation == "indirect", _REASONS["indirect"]).otherwise(_REASONS[""])
    listed = lambda c, n, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.slice(c, 1, n), ", "), F.lit(".")))
    return F.concat_ws(" ", base, listed(countries, 3, "Area: "), listed(entities, 4, "Linked entities/projects: "))


def batch_status(ok: Column, failed: Column, skipped: Column, last_status: Column) -> Column:
    """What the batches of a run come to."""
    return F.when((ok > 0) & (failed + skipped > 0), "partial").when(ok > 0, "ok").otherwise(F.coalesce(F.nullif(last_status, F.lit("")), F.lit("empty")))


def diagnose(log: Column, code: Column, rows: Column, needles: list[tuple[str, list[str]]]) -> Column:
    """A crawler's outcome: the first group of needles found in its log, else by exit code and rows."""
    out = F.when(code != 0, "process_failed").when(rows == 0, "empty").otherwise("ok")
    for name, words in reversed(needles):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(log), F.lit(w.lower()))
        out = F.when(hit, name).otherwise(out)
    return out
