"""Fixed values that results depend on: word lists, patterns and tables, given as defaults of parameters."""

from __future__ import annotations

#: English words that are no tokens.
STOP_WORDS = (
    "the a an and or of to in on for from with at by as is are was were be been being this that these those it its their his her our your "
    "after before amid over under new says say report reports update latest live news how what why who when where into about against more could"
).split()

#: Severity labels, their scores and patterns, the first match wins.
SEVERITIES = [
    (
        "critical", 100,
        r"\b(nuclear attack|nuclear strike|ballistic missile|missile strike|airstrike|air strike|invasion|martial law|coup d'etat|coup|evacuation order|mass casualty|hostage crisis|state of emergency|war declared|blockade)\b"
        r"|核打击|核袭击|导弹袭击|空袭|入侵|政变|戒严|撤侨|大规模伤亡|人质危机|进入紧急状态|封锁",
    ),
    (
        "high", 75,
        r"\b(military drill|military exercise|troop buildup|troop build-up|mobilization|armed clash|border clash|explosion|bombing|terror attack|riot|violent protest|embassy attack|factory shutdown|mine shutdown|port closure|shipping disruption"
        r"|sanctions|export controls?|blacklist|evacuation|detention|arrested|killed|dead|casualties|cyberattack|internet shutdown|power outage)\b"
        r"|军演|军事演习|增兵|军事集结|武装冲突|边境冲突|爆炸|炸弹|恐袭|骚乱|暴力抗议|使馆遇袭|工厂停产|矿山停产|港口关闭|航运中断|制裁|出口管制|黑名单|撤离|拘留|被捕|死亡|伤亡|网络攻击|断网|停电",
    ),
    (
        "medium", 50,
        r"\b(protest|strike|demonstration|election|government change|cabinet reshuffle|tariff|investigation|probe|investment review|military|navy|air force|coast guard|trade restriction|supply chain|mine|port|railway|energy project|semiconductor|critical minerals)\b"
        r"|抗议|罢工|示威|大选|政府更迭|内阁改组|关税|调查|投资审查|军方|海军|空军|海警|贸易限制|供应链|矿山|港口|铁路|能源项目|半导体|关键矿产",
    ),
]

#: Categories of a text without a risk category, the first match wins.
CATEGORIES = [
    ("安全/冲突", r"military|war|conflict|missile|airstrike|troop|navy|army|air force|coast guard|attack|explosion|terror|军|战争|冲突|导弹|空袭|袭击|爆炸|恐袭"),
    ("台海/印太", r"taiwan|taipei|south china sea|philippines|spratly|senkaku|diaoyu|indo-pacific|台海|台湾|南海|菲律宾|钓鱼岛|印太"),
    ("外交/制裁", r"sanction|diplomat|embassy|foreign minister|summit|visa|blacklist|export control|制裁|外交|使馆|峰会|签证|黑名单|出口管制"),
    ("经贸/科技", r"tariff|trade|semiconductor|chip|ai\b|battery|ev\b|electric vehicle|investment|factory|supply chain|关税|贸易|半导体|芯片|人工智能|电池|电动车|投资|工厂|供应链"),
    ("海外利益", r"mine|mining|port|railway|pipeline|power plant|industrial park|workers?|citizens?|矿|港口|铁路|管道|电站|工业园|员工|公民|华人"),
    ("社会动荡", r"protest|strike|riot|demonstration|unrest|抗议|罢工|骚乱|示威|动荡"),
]
OTHER_CATEGORY = "其他"

#: Words of one language that stand for tokens of another.
CONCEPTS = {
    "中国": "china chinese", "中资": "china chinese", "中国企业": "china company", "中国员工": "china workers", "中国工人": "china workers",
    "台湾": "taiwan", "台海": "taiwan strait", "海峡": "strait", "南海": "south china sea", "解放军": "pla military", "军演": "military drills", "军事演习": "military drills",
    "抗议": "protest", "示威": "protest", "罢工": "strike", "骚乱": "riot", "冲突": "conflict", "袭击": "attack", "围殴": "attack attacked assaulted", "爆炸": "explosion",
    "死亡": "killed dead", "死伤": "killed casualties", "伤亡": "casualties", "工人": "workers", "员工": "workers", "矿山": "mine", "铜矿": "copper mine", "锂矿": "lithium mine", "镍矿": "nickel mine",
    "港口": "port", "铁路": "railway", "工厂": "factory", "工业园": "industrial park", "停产": "shutdown", "关闭": "closure", "封锁": "blockade blocked", "入口": "entrance", "附近": "near",
    "赞比亚": "zambia", "刚果": "congo", "巴基斯坦": "pakistan", "菲律宾": "philippines", "缅甸": "myanmar", "柬埔寨": "cambodia", "印度尼西亚": "indonesia", "印尼": "indonesia", "匈牙利": "hungary", "塞尔维亚": "serbia",
}

#: Patterns of the relevance cascade.
DIRECT = (
    r"\b(china|chinese|beijing|prc|people'?s republic of china|xi jinping|ccp|cpc|pla|renminbi|yuan|hong kong|xinjiang|tibet|taiwan)\b"
    r"|\b(huawei|byd|catl|cosco|zte|smic|bytedance|tiktok|cnooc|sinopec|petrochina|crrc|alibaba|tencent|lenovo|geely|saic|chery|great wall motor|china railway|state grid|zijin)\b"
    r"|中国|中方|中资|中国企业|中国员工|中国公民|华人|北京|习近平|中共|中共中央|国务院|外交部|商务部|国台办|央企|人民币|解放军|台湾|台海|南海|华为|比亚迪|宁德时代|中远海运|紫金矿业|中石油|中石化|中国铁路|一带一路"
)
MAJOR = (
    r"\b(election|electoral|vote|government|cabinet|president|prime minister|coalition|parliament|congress|policy|regulation|law|bill|ban|tariff|sanction|blacklist|export control|investment|subsidy|review|probe|investigation|military|defen[cs]e|war|conflict|coup"
    r"|protest|strike|riot|unrest|terror|port|mine|mining|copper|lithium|nickel|rare earth|oil|gas|energy|rail|railway|telecom|semiconductor|chip|battery|ev|electric vehicle|infrastructure|nuclear|space|satellite|cyber|data|artificial intelligence|\bai\b|trade"
    r"|supply chain|shipping|shipping lane|currency|central bank|interest rate|foreign policy|diplomatic|diplomacy|alliance|nato|eu|european union|evacuation|attack|explosion|shutdown|closure)\b"
    r"|大选|选举|政府|内阁|总统|总理|政策|监管|法律|禁令|关税|制裁|黑名单|出口管制|投资|补贴|审查|调查|军事|国防|战争|冲突|政变|抗议|罢工|骚乱|恐袭|港口|矿山|铜|锂|镍|稀土|石油|天然气|能源|铁路|电信|半导体|芯片|电池|电动车|基础设施|核|卫星|网络|人工智能|贸易|供应链|航运|央行|利率|外交|联盟|撤离|袭击|爆炸|停产|关闭"
)
LEISURE = (
    r"\b(football|soccer|basketball|baseball|tennis|golf|formula 1|f1|olympic|league|cup final|celebrity|actor|actress|movie|film festival|music|singer|concert|fashion|recipe)\b"
    r"|足球|篮球|网球|高尔夫|奥运|联赛|明星|演员|电影|音乐|演唱会|时尚|菜谱"
)
HOME_COUNTRIES = ("China", "Hong Kong", "Taiwan")
GENERIC_PROFILES = ("global", "europe", "africa", "nato", "european union")

#: Query parameters that do not tell pages apart.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid".split()

#: Scores of source tiers, and keys of engagement that count.
TIER_SCORES = {1: 100, 2: 75, 3: 50, 4: 25}
ENGAGEMENT = "like_count retweet_count reply_count quote_count share_count comment_count".split()

#: Beginnings of the last line of an exception.
EXCEPTIONS = "AttributeError: ModuleNotFoundError: ImportError: RuntimeError: ValueError: TypeError: Exception:".split()
