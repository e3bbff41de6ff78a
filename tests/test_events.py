"""Event building on the survey's goldens: a post, the same an hour later, and an official report two hours after."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, tables

NOW = datetime(2026, 8, 19, 8)
CFG = events.Config(
    tiers=[(1, "official"), (2, "reuters")], families={"official-family": ["official"], "reuters-family": ["reuters"]},
    taxonomy={"labor_social": {"label_zh": "劳工", "label_en": "Labor", "exposure_weight": 70, "terms": ["罢工"]}, "personnel_security": {"label_zh": "人员安全", "label_en": "Personnel security", "exposure_weight": 95, "terms": ["围殴", "attacked"]}}, escalation=["killed"],
)
POST = {
    "id": "s1", "text": "当地消息称柬埔寨一中资工业园4名中国工人遭围殴，1人死亡3人重伤", "title": "柬埔寨中资工业园中国工人遭围殴致死伤", "platform": "telegram", "author": "local-eye", "source": "telegram · local-eye", "source_kind": "social",
    "published_at": NOW - timedelta(hours=2), "collected_at": NOW, "relation": "direct", "confidence": 28, "entities": ["中国工人", "中资工业园"], "country": "Cambodia", "reason": "直接涉及海外中国人员和中资项目。", "url": "https://example.test/social/1",
}
REPORT = {
    "id": "n1", "title": "Official confirms Chinese workers attacked at Cambodia industrial park, one killed", "snippet": "Authorities opened an investigation after the attack.", "source": "Official Cambodia", "source_kind": "official",
    "published_at": NOW + timedelta(hours=3), "collected_at": NOW + timedelta(hours=3), "relation": "direct", "confidence": 95, "entities": ["中国工人", "中资工业园"], "country": "Cambodia", "reason": "直接涉及海外中国人员和中资项目。", "url": "https://example.test/official/1",
}
#: Expected values of the three runs.
GOLD = [
    dict(china_relevance_score=100, severity="low", novelty_score=100, momentum_score=55, freshness_score=92, exposure_score=100, risk_category="personnel_security", lifecycle="emerging", priority_score=74, confidence_score=26, importance_score=34, source_count=1, evidence_count=1),
    dict(china_relevance_score=100, severity="low", novelty_score=95, momentum_score=12, freshness_score=88, exposure_score=100, risk_category="personnel_security", lifecycle="emerging", priority_score=67, confidence_score=26, importance_score=34, source_count=1, evidence_count=1),
    dict(china_relevance_score=100, severity="high", novelty_score=95, momentum_score=82, freshness_score=100, exposure_score=100, risk_category="personnel_security", lifecycle="escalating", priority_score=90, confidence_score=77, importance_score=77, source_count=2, evidence_count=2),
]


def _frame(spark, rows):
    types = {**events.FIELDS}
    return spark.createDataFrame([tuple(r.get(c) for c in types) for r in rows], ", ".join(f"{c} {t}" for c, t in types.items()))


def _run(spark, news, posts, now, previous=None):
    return events.build_events(_frame(spark, news), _frame(spark, posts), F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"), previous, CFG)


@pytest.fixture(scope="module")
def runs(spark):
    first = _run(spark, [], [POST], NOW).cache()
    return [first.collect(), _run(spark, [], [POST], NOW + timedelta(hours=1), first).collect(), _run(spark, [REPORT], [POST], NOW + timedelta(hours=3), first).collect()]


@pytest.mark.parametrize("i", range(3))
def test_goldens(runs, i):
    assert len(runs[i]) == 1
    assert {k: runs[i][0][k] for k in GOLD[i]} == GOLD[i]


def test_state_between_runs(runs):
    one, same, later = (r[0] for r in runs)
    assert one["id"] == same["id"] == later["id"] and not one["previous_event_matched"] and same["previous_event_matched"] and later["previous_event_matched"]
    assert later["change"]["official_added"] and later["status"] == "官方信号" and one["status"] == "苗头"
    assert [len(r["history"]) for r in (one, same, later)] == [1, 2, 2] and [e["id"] for e in later["evidence"]] == ["n1", "s1"]
    assert one["why_now_zh"] == "人员安全信号；近期首次进入事件池；新增1条独立信息链；新颖度100 / 动量55。"
    assert later["why_now_en"] == "Personnel security signal; is escalating or spreading; 1 new independent source chain(s); official evidence appeared for the first time; novelty 95 / momentum 82."


def test_unrelated_rows_stay_apart_and_old_ones_go(spark):
    other = {**REPORT, "id": "n2", "title": "Central bank of Argentina cuts rates", "entities": [], "country": "Argentina"}
    old = {**REPORT, "id": "n3", "published_at": NOW - timedelta(days=8)}
    blank = {"id": "n4", "published_at": NOW}
    got = events.ordered(_run(spark, [other, old, blank], [POST], NOW + timedelta(hours=3))).collect()
    assert sorted(len(r["evidence"]) for r in got) == [1, 1] and got[0]["priority_score"] >= got[1]["priority_score"]
    assert _run(spark, [], [], NOW).count() == 0
