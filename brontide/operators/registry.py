"""Registry operators: summaries, audits, citations, news ranking, law text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.functions.text import compact, top_category
from brontide.operators import relate
from brontide.sources.stored import written

#: Domains of a verification item by the first pattern that fits, and the evidence each asks for.
DOMAINS = (
    ("정보시스템", "시스템|전산|온라인|데이터|DB|연계", "공식 시스템 매뉴얼 또는 운영기관 확인"),
    ("처리기간", "기한|기간|소요|처리일|지연", "처리대장·통계 또는 담당자 인터뷰"),
    ("문서·증빙", "서식|문서|자료|증빙|보고서", "현행 서식·업무편람 또는 공식 안내"),
    ("재정·비용", "예산|비용|수수료|금액|재원", "예산서·수수료 고시 또는 결산자료"),
    ("실무 관행", "관행|실무|내부|현장|운영", "복수 실무자 인터뷰와 공개 업무편람"),
    ("기관·권한", "기관|부처|지자체|담당|권한", "직제·사무분장 또는 담당기관 확인"),
)
OTHER_DOMAIN = ("운영 사실", "소관기관 공식 문서 또는 담당자 확인")
#: Words that say nothing about which law is meant.
LAW_STOP = ("관련", "관한", "등에", "등의", "법률", "시행령", "시행규칙", "규정", "기준", "지침", "고시", "내부규정")
#: Shapes of article references.
RANGE = r"제\s*(\d+)\s*(?:조(?:\s*의\s*(\d+))?)?\s*[~-]\s*(?:제\s*)?(\d+)\s*조(?:\s*의\s*(\d+))?"
SINGLE = r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?"
#: Rule tables of the law text reader; the first pattern that fits counts.
LANES = (
    ("사업자|시행자|개발사업자", "사업자/시행자"),
    ("평가대행자|환경영향평가업자", "평가대행자"),
    ("승인기관|승인기관의 장|인가기관|허가기관", "승인기관"),
    ("시장|군수|구청장|지방자치단체|시ㆍ군ㆍ구|시·군·구", "관할 지자체"),
    ("협의기관|환경부장관|기후에너지환경부장관|유역환경청|지방환경청", "협의기관"),
    ("협의회|위원회", "위원회/협의회"),
    ("전문기관|한국환경연구원|관계 행정기관|해양수산부장관", "전문검토기관/관계기관"),
    ("주민|이해관계자|의견을 제출", "주민/이해관계자"),
    ("정보지원시스템|정보통신망|시스템", "정보시스템"),
)
ACTIONS = (
    ("작성", "작성"), ("제출", "제출"), ("요청|요구", "요청"), ("접수", "접수"), ("검토", "검토"), ("심의", "심의"), ("협의", "협의"), ("보완", "보완"), ("반려", "반려"),
    ("통보|알려야", "통보"), ("공고", "공고"), ("공람", "공람"), (r"의견\s*수렴|의견을\s*듣|의견을\s*수렴", "의견수렴"), ("승인|허가|인가|확정", "승인"), ("고시", "고시"), ("조사", "조사"), ("이행", "이행"), ("공개|게시", "공개"),
)
STAGES = (
    ("대상|판정|사업의 종류|대상사업", "G0 대상판정"),
    ("평가준비서|평가항목|범위|방법|협의회|대안|스코핑", "G1 착수·스코핑"),
    ("초안|현황조사|영향예측|저감방안|조사", "G2 조사·초안"),
    ("공고|공람|열람|설명회|공청회", "G3 공고·공람"),
    ("의견|본안|반영|미반영", "G4 의견수렴·본안"),
    ("협의 요청|협의요청|검토|전문기관|보완|반려|재검토", "G5 협의검토·보완"),
    ("협의내용|통보|승인(?!기관)|허가|인가|확정|고시", "G6 협의통보·승인"),
    ("이행|사후|착공|준공|관리대장|조치명령|재협의|변경", "G7 이행·사후관리"),
)
DEADLINE = r"(\d+\s*(?:일|개월|년)\s*이내|\d+\s*(?:일|개월|년)\s*전까지|지체\s*없이|즉시)"


def first_match(c: Column, table: tuple[tuple[str, str], ...], default: Column | str | None = None) -> Column:
    """The value of the first pattern of the table that fits."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for pattern, value in reversed(table):
        out = F.when(c.rlike(pattern), value).otherwise(out)
    return out


def classify_domain(c: Column) -> Column:
    return first_match(c, tuple((p, d) for d, p, _ in DOMAINS), OTHER_DOMAIN[0])


def suggested_evidence(domain: Column) -> Column:
    out = F.lit(OTHER_DOMAIN[1])
    for d, _, e in DOMAINS:
        out = F.when(domain == d, e).otherwise(out)
    return out


def compact_law(c: Column) -> Column:
    """A law's name without parenthesised parts, white space and quotation or separating marks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", ""), r"(?U)[\s「」『』“”‘’·ㆍ,;:/]", "")


#: Names that stand for several laws.
COMPOSITES = {
    "근로기준법·노동조합 및 노동관계조정법": ("근로기준법", "노동조합 및 노동관계조정법"),
    "방송심의에 관한 규정·정보통신에 관한 심의규정": ("방송심의에 관한 규정", "정보통신에 관한 심의규정"),
    "난민법 및 행정소송법": ("난민법", "행정소송법"),
    "민법·상법 등 실체법": ("민법", "상법"),
    "법률구조법 시행령·공단 내부규정": ("법률구조법 시행령",),
    "인공지능 기본법 시행령·고시": ("인공지능 기본법 시행령",),
}
#: How a citation says that it means a law and what is below it.
_AND_BELOW = r"(?U)\s+및\s+하위법령\s*$"


def law_targets(citations: DataFrame, aliases: DataFrame, composites: dict[str, tuple[str, ...]] = COMPOSITES) -> DataFrame:
    """citations with target and below: a row for each law that a citation stands for.

    A composite name gives its parts, an alias its official name, any other name
    itself.  below: the citation also means every law whose name begins with the target's.
    """
    known = F.create_map(*(x for k, v in composites.items() for x in (compact_law(F.lit(k)), F.array(*map(F.lit, v)))))
    official = aliases.groupBy(compact_law(F.col("alias")).alias("law_key")).agg(F.min("official").alias("law_official"))
    c = citations.withColumn("law_key", compact_law(F.col("law"))).withColumn("below", F.coalesce(F.col("law").rlike(_AND_BELOW), F.lit(False))).join(official, "law_key", "left")
    parts = F.coalesce(F.try_element_at(known, F.col("law_key")), F.array(F.coalesce("law_official", F.regexp_replace("law", _AND_BELOW, ""))))
    return c.withColumn("target", F.explode(parts)).drop("law_key", "law_official")


def find_sources(citations: DataFrame, sources: DataFrame, aliases: DataFrame, composites: dict[str, tuple[str, ...]] = COMPOSITES) -> DataFrame:
    """(id, url): the distinct sources that each citation (id, law) means.

    sources: (url, name, official), either name may match, in its compact form; a
    target's alias counts for the target.  Names that begin with a target are
    found through all their beginnings, so this is an equi-join too.  Citations
    that say the same are one class, and so are sources: classes are compared, and
    only the result has a row for each pair of their members.
    """
    ids = written(relate.classes(citations.select("id", "law"), "id"))
    urls = written(relate.classes(sources.select("url", "name", "official"), "url"))
    alias = aliases.groupBy(compact_law(F.col("alias")).alias("key")).agg(F.min(compact_law(F.col("official"))).alias("other"))
    said = ids.select(F.col("key").alias("id")).distinct().select("id", F.inline("id"))
    t = written(law_targets(said, aliases, composites).withColumn("key", compact_law(F.col("target"))).join(alias, "key", "left"))
    wanted = t.select("id", "below", F.explode(F.array_compact(F.array("key", "other"))).alias("key")).filter("key <> ''")
    named = urls.select(F.col("key").alias("url")).distinct().select("url", F.inline("url"))
    names = written(named.select("url", F.explode(F.array_compact(F.array("name", "official"))).alias("name")).select("url", compact_law(F.col("name")).alias("key")).filter("key <> ''"))
    starts = names.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("key"))
    same = wanted.join(names, "key").select("id", "url")
    under = t.filter("below").select("id", "key").join(starts, "key").select("id", "url")
    pairs = same.unionByName(under).distinct().withColumnsRenamed({"id": "a", "url": "b"})
    return relate.members(pairs, ids, urls).select(F.col("x").alias("id"), F.col("y").alias("url"))


def match_sources(citations: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """citations (id, law) with source: by compacted name, else by the alias's official name.

    Two equi-joins on compacted names; several sources of one name give the least.
    """
    named = sources.select(compact_law(F.col("name")).alias("k"), "name").groupBy("k").agg(F.min("name").alias("source"))
    official = aliases.groupBy(compact_law(F.col("alias")).alias("k")).agg(F.min(compact_law(F.col("official"))).alias("o"))
    c = citations.withColumn("k", compact_law(F.col("law")))
    direct = c.join(named, "k", "left").join(official, "k", "left")
    via = named.select(F.col("k").alias("o"), F.col("source").alias("via"))
    return direct.join(via, "o", "left").select(*citations.columns, F.coalesce("source", "via").alias("source"))


def article_coverage(references: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per institution: its article references by outcome, its unresolved sources, and its status.

    references: (slug, status) with status verified, missing or uncheckable;
    institutions: (slug, priority, unresolved).  article-verified: nothing is
    unresolved, missing or uncheckable; else needs-review.  An institution without
    references has zeros.
    """
    counts = references.groupBy("slug").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "missing", "uncheckable")))
    j = institutions.select("slug", "priority", "unresolved").join(counts, "slug", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    clean = (n("unresolved") == 0) & (n("missing") == 0) & (n("uncheckable") == 0)
    return j.select("slug", "priority", n("n").alias("article_references"), *(n(s).alias(s) for s in ("verified", "missing", "uncheckable")), n("unresolved").alias("unresolved"), F.when(clean, "article-verified").otherwise("needs-review").alias("status"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """One row: the report's seven figures over article_coverage."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return coverage.agg(F.count("*").alias("institutions"), F.count_if(F.col("status") == "article-verified").alias("article_verified"), *map(s, ("article_references", "verified", "missing", "uncheckable", "unresolved")))


def issue_groups(occurrences: DataFrame, key: list[str], at: str) -> DataFrame:
    """Issues with how often they occur, and where: (key, occurrences, places); places distinct and sorted."""
    return occurrences.groupBy(*key).agg(F.count("*").alias("occurrences"), F.sort_array(F.collect_set(at)).alias("places"))


def shared_top_category(docs: DataFrame, group: str, category: str) -> DataFrame:
    """(group, top, shared): whether all of a group's documents, two at least, have one top category, and which.

    The top category is what stands before " - ".
    """
    top = top_category(F.col(category), "")
    return docs.groupBy(group).agg(F.min(top).alias("top"), ((F.countDistinct(top) == 1) & (F.count("*") >= 2) & (F.min(top) != "")).alias("shared")).withColumn("top", F.when(F.col("shared"), F.col("top")))


def label(article: Column, branch: Column) -> Column:
    return F.concat(F.lit("제"), article.cast("string"), F.lit("조"), F.when(branch.isNotNull(), F.concat(F.lit("의"), branch.cast("string"))).otherwise(""))


def article_references(c: Column) -> Column:
    """Distinct article labels: ranges first, spelled out up to 200 articles or 100 branches, then single ones outside ranges."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "[∼～〜–—]", "~")
    numbers = lambda m, shape, n: F.struct(*(F.regexp_extract(m, shape, i).try_cast("int").alias(f"n{i}") for i in range(1, n + 1)))

    def spelled(m: Column) -> Column:
        a, ab, z, zb = (m[f"n{i}"] for i in (1, 2, 3, 4))
        branches = (a == z) & ab.isNotNull() & zb.isNotNull() & (zb >= ab) & (zb - ab <= 100)
        articles = ab.isNull() & zb.isNull() & (z >= a) & (z - a <= 200)
        none = F.lit(None).cast("int")
        return (
            F.when(F.coalesce(branches, F.lit(False)), F.transform(F.sequence(F.coalesce(ab, F.lit(0)), F.coalesce(zb, F.lit(0))), lambda b: label(a, b)))
            .when(F.coalesce(articles, F.lit(False)), F.transform(F.sequence(a, F.greatest(a, z)), lambda x: label(x, none)))
            .otherwise(F.array(label(a, ab), label(z, zb)))
        )

    ranges = F.flatten(F.transform(F.transform(F.regexp_extract_all(text, F.lit(RANGE), 0), lambda m: numbers(m, RANGE, 4)), spelled))
    rest = F.regexp_replace(text, RANGE, " ")
    said = lambda m: F.struct(F.regexp_extract(m, SINGLE, 1).alias("a"), F.regexp_extract(m, SINGLE, 2).alias("b"))
    single = F.transform(F.transform(F.regexp_extract_all(rest, F.lit(SINGLE), 0), said), lambda x: label(x["a"], F.when(x["b"] != "", x["b"])))
    return F.array_distinct(F.concat(ranges, single))


#: An article at the start of a line, and references to articles of another law.
HEADER = r"(?m)^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?=\s|\(|$)"
_ARTICLE = r"제\s*\d+\s*조(?:\s*의\s*\d+)?(?:\s*제\s*\d+\s*(?:항|호|목))*"
CROSS_LAW = r"(?:[가-힣A-Za-z0-9·ㆍ]+(?:법률|법)|설치법|산안법|근기법|노조법|시행령|시행규칙|통칙|영|법)\s+" + _ARTICLE + r"(?:\s*[·,]\s*" + _ARTICLE + ")*"


def article_headers(c: Column) -> Column:
    """Distinct labels of the articles that a law's text has: those that begin a line."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HEADER), 0)
    part = lambda m, i: F.regexp_extract(m, r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?", i)
    return F.array_distinct(F.transform(found, lambda m: label(part(m, 1), F.when(part(m, 2) != "", part(m, 2)))))


def mask_cross_law(c: Column) -> Column:
    """A text without its references to articles of other laws, so that article_references finds its own law's alone."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CROSS_LAW, "")


def registry_stats(summaries: DataFrame, nodes: str, articles: str, verified: str, sources: str, status: str) -> DataFrame:
    """One row: models, process nodes, article references, verified ones, sources, and models by the two states that count."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return summaries.agg(F.count("*").alias("models"), total(nodes, "process_nodes"), total(articles, "article_references"), total(verified, "verified_references"), total(sources, "sources"), F.count_if(F.col(status) == "article-verified").alias("article_verified"), F.count_if(F.col(status) == "needs-review").alias("needs_review"))


#: Names of documents in the order they are looked for, what else ends like one, who receives, and what a condition looks like.
DOCUMENTS = ("평가준비서", "환경영향평가서", "평가서", "평가서 초안", "약식평가서", "보완서", "협의내용", "협의내용 통보서", "사업계획", "의견서", "의견반영표", "사후환경영향조사서", "관리대장", "공고문", "공람대장", "심의결과", "검토의견")
DOCUMENT = r"([가-힣A-Za-z0-9·ㆍ\-]{2,20}(?:서|서류|계획|계획서|결과|의견|공문))"
RECEIVER = r"([가-힣A-Za-z0-9·ㆍ\s]{2,25})(?:에게|에)\s*(?:제출|통보|요청|요구|송부)"
CONDITIONS = (r"(.{0,25}경우)", r"(.{0,25}때)", r"(.{0,25}필요하다고 인정하는 경우)", r"(.{0,25}대통령령으로 정하는)")
MOST_DOCUMENTS, NAME_CHARS = 6, 24


def law_steps(text: Column) -> Column:
    """array<struct<article, sentence, lane, action, stage, deadline, type, confidence, documents, receiver, condition, name>> of a law's text.

    documents: those of DOCUMENTS in the sentence, then other words that end like
    one, MOST_DOCUMENTS at most.  receiver: who something is handed to, condition:
    the words up to a condition's end, both null without one.  name: the first
    document and the action, else the action, else the sentence's beginning.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r", "\n")
    parts = F.split(plain, r"(?=제\d+조(?:의\d+)?(?:\([^\)]*\)))")
    tidy = lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))

    def sentences(part: Column) -> Column:
        article = F.regexp_extract(part, r"^(제\d+조(?:의\d+)?(?:\([^\)]*\))?)", 1)
        found = F.filter(F.transform(F.split(part, r"(?<=[다음임함있])\.\s*"), tidy), lambda s: F.length(s) >= 12)
        return F.transform(found, lambda s: F.struct(F.when(article == "", "조문 미상").otherwise(article).alias("article"), s.alias("sentence")))

    some = lambda c: F.when(c != "", c)

    def read(x: Column) -> Column:
        s = x["sentence"]
        known = F.array_compact(F.array(*(F.when(F.contains(s, F.lit(d)), d) for d in DOCUMENTS)))
        other = F.filter(F.regexp_extract_all(s, F.lit(DOCUMENT), 1), lambda d: F.length(d) <= 20)
        return F.struct(
            x["article"].alias("article"),
            s.alias("sentence"),
            first_match(s, ACTIONS).alias("action"),
            first_match(s, LANES).alias("lane"),
            F.replace(F.regexp_extract(s, DEADLINE, 1), F.lit(" "), F.lit("")).alias("deadline"),
            F.slice(F.array_distinct(F.concat(known, other)), 1, MOST_DOCUMENTS).alias("documents"),
            tidy(F.regexp_extract(s, RECEIVER, 1)).alias("receiver"),
            F.array(*(tidy(F.regexp_extract(s, c, 1)) for c in CONDITIONS)).alias("conditions"),
        )

    def judged(x: Column) -> Column:
        s, action, deadline, documents, receiver = x["sentence"], x["action"], x["deadline"], x["documents"], some(x["receiver"])
        actor = x["lane"].isNotNull()
        fallback = F.when(action.isin("공고", "공람"), "G3 공고·공람").when(action.isin("검토", "보완", "반려"), "G5 협의검토·보완").when(action.isin("통보", "승인", "고시"), "G6 협의통보·승인").otherwise("G1 착수·스코핑")
        condition = F.get(F.filter(x["conditions"], lambda c: c != ""), 0)
        kind = F.when(action.isin("보완", "반려"), "gateway").when(action.isin("공고", "공개") & condition.isNull(), "notice").otherwise("task")
        points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
        score = F.least(F.lit(95), F.lit(35) + points(action.isNotNull(), 25) + points(actor, 20) + points(F.size(documents) > 0, 15) + points(deadline != "", 5)) / 100
        begins = F.concat(F.substring(s, 1, NAME_CHARS), F.when(F.length(s) > NAME_CHARS, "…").otherwise(""))
        name = F.when((F.size(documents) > 0) & action.isNotNull(), F.concat(F.get(documents, 0), F.lit(" "), action)).when(action.isNotNull(), F.concat(action, F.lit(" 업무"))).otherwise(begins)
        return F.struct(
            x["article"].alias("article"),
            s.alias("sentence"),
            F.coalesce(x["lane"], F.lit("사업자/시행자")).alias("lane"),
            action.alias("action"),
            first_match(s, STAGES, fallback).alias("stage"),
            some(deadline).alias("deadline"),
            kind.alias("type"),
            score.alias("confidence"),
            documents.alias("documents"),
            receiver.alias("receiver"),
            condition.alias("condition"),
            name.alias("name"),
        )

    return F.transform(F.transform(F.flatten(F.transform(F.filter(parts, lambda p: F.trim(p) != ""), sentences)), read), judged)


def rank_news(items: DataFrame, signals: dict[str, tuple[str, ...]], existing: tuple[str, ...], sources: dict[str, int], k: int = 30) -> DataFrame:
    """Candidates by signal words, one per URL or compacted title, positive scores only: (url, title, published, score)."""
    text = F.concat_ws(" ", "title", "body")
    hits = lambda words: reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    known = reduce(lambda a, b: a + b, (F.contains(compact(text), compact(F.lit(n))).cast("int") for n in existing), F.lit(0))
    weight = reduce(lambda a, kv: F.when(F.col("source_type") == kv[0], kv[1]).otherwise(a), sources.items(), F.lit(1))
    score = weight + 2 * hits(signals["institution"]) + 2 * hits(signals["process"]) + 3 * hits(signals["novelty"]) - 5 * known - 20 * hits(signals["noise"])
    identity = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(compact(F.col("title")))
    first = Window.partitionBy("identity").orderBy("ordinal")
    once = items.withColumn("identity", identity).filter("identity <> ''").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return once.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc("published"), "ordinal").limit(k).select("url", "title", "published", "score")


def z_outliers(df: DataFrame, id: str, metrics: list[str], limit: float = 2.0) -> DataFrame:
    """(id, metric, z): values more than `limit` population deviations from the mean, over one aggregated row."""
    stats = df.agg(*(F.avg(m).alias(f"m_{m}") for m in metrics), *(F.stddev_pop(m).alias(f"s_{m}") for m in metrics))
    j = df.crossJoin(F.broadcast(stats))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col(f"s_{m}") > 0, (F.col(m) - F.col(f"m_{m}")) / F.col(f"s_{m}")).alias("z")) for m in metrics))
    return j.select(id, F.inline(rows)).filter(F.abs("z") > limit).select(id, "metric", F.round("z", 4).alias("z"))


def audit_priority(df: DataFrame, id: str, needs_review: Column, warnings: Column, high: Column, low: Column) -> DataFrame:
    """(id, priority): 3 if it needs review, up to 3 warnings, 2 per severe and 1 per minor finding."""
    return df.groupBy(id).agg((3 * F.max(needs_review.cast("int")) + F.least(F.sum(warnings.cast("int")), F.lit(3)) + 2 * F.sum(high.cast("int")) + F.sum(low.cast("int"))).alias("priority"))


def merge_sources(generated: DataFrame, existing: DataFrame, key: str, value: str, pinned: str) -> DataFrame:
    """Full outer merge: a pinned existing value wins, else the generated one; unmatched existing rows stay."""
    g, e = generated.select(key, F.col(value).alias("g")), existing.select(key, F.col(value).alias("e"), F.col(pinned).alias("p"))
    j = g.join(e, key, "full_outer")
    return j.select(key, F.when(F.col("p"), F.coalesce("e", "g")).otherwise(F.coalesce("g", "e")).alias(value), F.when(F.col("g").isNull(), "existing").when(F.coalesce("p", F.lit(False)), "pinned").otherwise("generated").alias("origin"))


def date_window(day: Column, back: int = 2) -> Column:
    """array of the first and last day, as yyyymmdd, of the window that ends on day."""
    return F.array(F.date_format(F.date_sub(day, back), "yyyyMMdd"), F.date_format(day, "yyyyMMdd"))


def kst_date(published: Column) -> Column:
    """The day in Korea, yyyy-MM-dd, of an RFC 822 or ISO date with its offset, or of a policy's MM/dd/yyyy; else null."""
    text = F.trim(F.coalesce(published, F.lit("")))
    policy = F.regexp_extract(text, r"^(\d{2})/(\d{2})/(\d{4})", 0)
    plain = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    rfc = F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), text.try_cast("timestamp"))
    day = F.date_format(F.convert_timezone(None, F.lit("Asia/Seoul"), F.coalesce(rfc, iso).cast("timestamp_ntz")), "yyyy-MM-dd")
    return F.when(policy != "", F.concat_ws("-", F.substring(policy, 7, 4), F.substring(policy, 1, 2), F.substring(policy, 4, 2))).otherwise(day)
