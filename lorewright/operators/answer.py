"""From hits to answers: ranking, evidence, context, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright import shared
from lorewright.functions import text as T
from lorewright.functions import vectors as V
from lorewright.schemas import Settings

KEY = ["query_id", "video_name", "chunk_id"]


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """One row per query, video and chunk (AG10): the largest scores, the longest text (the first of equals), sources appended wherever they differ from all so far, segments united and sorted if there were several rows."""
    ordered = F.array_sort(F.collect_list(F.struct("branch_ord", "arrival", "source", "segment_ids", "chunk_text")))
    sources = F.aggregate(F.transform("h", lambda x: x["source"]), F.lit(""), lambda acc, s: F.when(acc == "", s).when(acc == s, acc).otherwise(F.concat(acc, F.lit("|"), s)))
    texts = F.aggregate(F.transform("h", lambda x: x["chunk_text"]), F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))
    ids = F.when(F.size("h") == 1, F.get("h", F.lit(0))["segment_ids"]).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda x: F.coalesce(x["segment_ids"], F.array().cast("array<string>")))))))
    rows = hits.groupBy(*KEY).agg(ordered.alias("h"), *[F.max(c).alias(c) for c in ("score_semantic", "score_entity", "score_graph", "final_score")])
    first = F.get("h", F.lit(0))
    return rows.select(*KEY, first["branch_ord"].alias("branch_ord"), first["arrival"].alias("arrival"), sources.alias("source"), texts.alias("chunk_text"), ids.alias("segment_ids"), "score_semantic", "score_entity", "score_graph", "final_score")


def component_scores(hits: DataFrame, query: str = "query", terms: str = "terms") -> DataFrame:
    """The three scores with their lexical fallbacks (MV3). hits have the query's text and its entity terms."""
    q = T.tokens(F.col(query))
    overlap = F.size(F.array_intersect(q, T.tokens(F.col("chunk_text")))) / F.greatest(F.lit(1), F.size(q))
    lower = F.lower("chunk_text")
    bonus = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(lower, F.lower(t)))) / F.greatest(F.lit(1), F.size(terms))).otherwise(0.0)
    rows = hits.withColumns({"overlap": overlap, "bonus": bonus})
    lexical = F.col("overlap")
    fallback = F.when(F.contains("source", F.lit("graph")), F.least(F.lit(1.0), F.lit(0.25) + F.lit(0.75) * lexical)).otherwise(F.lit(0.20) * lexical)
    return rows.withColumns(
        {
            "score_entity": F.greatest(F.col("score_entity"), F.lit(0.65) * lexical + F.lit(0.35) * F.col("bonus")),
            "score_graph": F.when(F.col("score_graph") <= 0, fallback).otherwise(F.col("score_graph")),
            "score_semantic": F.when(F.col("score_semantic") <= 0, lexical).otherwise(F.col("score_semantic")),
        }
    ).drop("overlap", "bonus")


def diversify(hits: DataFrame, cap: Column, final_k: int = Settings.final_k) -> DataFrame:
    """The final_k best hits of each query, at most cap of a video (WN5, TK6): ranks within video and query are those of the greedy pass, as its first hit is its video's first."""
    order = [F.desc("final_score"), F.asc("branch_ord"), F.asc("arrival"), F.asc("video_name"), F.asc("chunk_id")]
    rows = hits.withColumn("in_video", F.row_number().over(Window.partitionBy("query_id", "video_name").orderBy(*order))).where(F.col("in_video") <= cap)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= final_k).drop("in_video")


def focused(queries: DataFrame, videos: DataFrame) -> DataFrame:
    """query_id and single: whether the query names exactly one of the videos (TX38). Each video meets the query batch; a row per query comes out."""
    asked = shared.checked(queries.select("query_id", F.lower("query").alias("q")))
    named = videos.select(F.replace(F.lower("video_name"), F.lit("_"), F.lit(" ")).alias("slug"), "video_name").distinct().crossJoin(asked).where(F.contains("q", F.col("slug")))
    return named.groupBy("query_id").agg((F.count("*") == 1).alias("single"))


def rerank(hits: DataFrame, queries: DataFrame, videos: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Q4. queries: query_id, query, intent; videos: video_name, the engine's list of sources."""
    s = settings or Settings()
    asked = queries.join(focused(queries, videos), "query_id", "left")
    cap = F.when(F.coalesce("single", F.lit(False)), s.final_k).when(F.col("intent.is_cross_video"), s.per_video_cross).otherwise(s.per_video)
    asked = asked.select("query_id", "query", F.col("intent.entity_focus_terms").alias("terms"), cap.alias("cap"))
    rows = component_scores(dedupe_hits(hits).join(asked, "query_id"))
    rows = rows.withColumn("final_score", V.weighted(F.col("score_semantic"), F.col("score_entity"), F.col("score_graph"), s))
    return diversify(rows, F.col("cap"), s.final_k).drop("query", "terms", "cap")


def time_spans(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """Per key of refs (…, video_name, segment_ids): span from the first start to the last end of its segments, unknown where none has a time (JN7, AG12)."""
    key = [c for c in refs.columns if c != "segment_ids"]
    parsed = segments.select("video_name", "segment_idx", T.number(F.substring_index("time", "-", 1)).alias("s"), T.number(F.substr("time", F.instr("time", "-") + 1)).alias("e")).where(F.contains("time", F.lit("-")) & F.col("s").isNotNull() & F.col("e").isNotNull()) if "time" in segments.columns else segments
    rows = refs.select(*key, F.explode_outer("segment_ids").alias("ref")).withColumn("segment_idx", F.substring_index("ref", "_", -1)).join(parsed.select("video_name", "segment_idx", "s", "e"), ["video_name", "segment_idx"], "left")
    span = F.concat(T.hms(F.min("s")), F.lit("-"), T.hms(F.max("e")))
    return rows.groupBy(*key).agg(F.when(F.count("s") > 0, span).otherwise("unknown").alias("time_span"))


BUDGET = "struct<used:bigint,out:array<struct<at:int,text:string,tokens:bigint>>>"


def budget_blocks(texts: Column, budget: int, cap: int = 900, floor: int = 240) -> Column:
    """Array of (at, text, tokens): texts in order while the budget isn't used up, each cut to min(cap, max(floor, what is left)) tokens (WN7). The list is the few hits of a query."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<at:int,text:string,tokens:bigint>>").alias("out")).cast(BUDGET)
    items = F.transform(texts, lambda t, i: F.struct(i.cast("int").alias("at"), T.strip(t).alias("text")))

    def step(s: Column, x: Column) -> Column:
        left = F.lit(budget).cast("long") - s["used"]
        cut = T.cut_to_budget(x["text"], F.least(F.lit(cap).cast("long"), F.greatest(F.lit(floor).cast("long"), left)))
        more = F.struct((s["used"] + cut["tokens"]).alias("used"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), cut["text"].alias("text"), cut["tokens"].alias("tokens")))).alias("out"))
        return F.when((s["used"] >= budget) | (cut["text"] == ""), s).otherwise(more.cast(BUDGET))

    return F.aggregate(items, start, step, lambda s: s["out"])


def evidence(ranked: DataFrame, segments: DataFrame, budget: int = Settings.context_tokens) -> DataFrame:
    """Q5: evidence blocks (query_id, at, video_name, time_span, chunk_id, source, text, final_score) of ranked hits."""
    spans = time_spans(ranked.select("query_id", "video_name", "chunk_id", "segment_ids"), segments)
    rows = ranked.join(spans, KEY)
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "video_name", "time_span", "chunk_id", "source", "chunk_text", "final_score"))).alias("h"))
    blocks = listed.select("query_id", "h", F.explode(budget_blocks(F.transform("h", lambda x: x["chunk_text"]), budget)).alias("b"))
    h = F.get("h", F.col("b.at"))
    return blocks.select("query_id", F.col("b.at").alias("at"), h["video_name"].alias("video_name"), h["time_span"].alias("time_span"), h["chunk_id"].alias("chunk_id"), h["source"].alias("source"), F.col("b.text").alias("text"), F.col("b.tokens").alias("tokens"), h["final_score"].alias("final_score"))


def context(blocks: DataFrame) -> DataFrame:
    """The blocks of each query as one text (TX22)."""
    part = T.render_block(F.col("video_name"), F.col("time_span"), F.col("chunk_id"), F.col("source"), F.col("text"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def confidence(queries: DataFrame, blocks: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Confidence and its band per query (AG13, MV5). verified: query_id, supported_ratio, unsupported_ratio; none while verification is off, which keeps the confidence under 0.65."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    by = blocks.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg(clamp(F.col("final_score"))).alias("strength"), F.count_distinct(F.substring_index("source", "|", 1)).alias("sources"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", F.lower("text").alias("t")))), 1, 3), lambda x: x["t"]).alias("top"),
    )
    rows = queries.select("query_id", "query").join(by, "query_id", "left")
    zero = F.lit(0.0)
    rows = rows.join(verified, "query_id", "left").na.fill(0.0, ["supported_ratio", "unsupported_ratio"]) if verified is not None else rows.withColumns({"supported_ratio": zero, "unsupported_ratio": zero})
    words = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+", -1), lambda w: w != ""))
    seen = F.exists(words, lambda w: F.contains(F.array_join("top", " "), w))
    value = F.lit(0.5) * F.col("strength") + F.lit(0.35) * F.col("supported_ratio") + F.lit(0.15) * F.least(F.lit(1.0), F.col("sources") / 3.0)
    value = value - F.when(F.col("n") < 2, 0.15).otherwise(0.0) - F.when(F.col("unsupported_ratio") > 0.40, 0.25).otherwise(0.0) - F.when((F.size(words) > 0) & ~seen, 0.10).otherwise(0.0)
    rows = rows.withColumn("confidence", F.coalesce(clamp(value), zero))
    return rows.select("query_id", "confidence", V.band(F.col("confidence")).alias("band"))


def source_counts(hits: DataFrame) -> DataFrame:
    """Hits per query and source; a merged hit counts for each of its sources (AG11)."""
    return hits.select("query_id", F.explode(F.split("source", r"\|", -1)).alias("source")).groupBy("query_id", "source").agg(F.count("*").alias("n"))


def verification(answers: DataFrame) -> DataFrame:
    """Shares of labels per answer (query_id, answer, raw) and the answer as they leave it (AG14, TX24 to TX26, TX35)."""
    claims, given = T.sentences(F.col("answer")), T.verifier_labels(F.col("raw"))
    n = F.size(claims)
    labels = F.slice(F.concat(given, F.array_repeat(F.lit("uncertain"), F.greatest(n - F.size(given), F.lit(0)))), F.lit(1), n)
    rows = answers.withColumn("labels", labels)
    share = lambda label: F.size(F.filter("labels", lambda x: x == label)) / F.greatest(F.lit(1), F.size("labels"))
    bad = F.transform(F.filter(F.transform("labels", lambda x, i: F.struct((i + 1).alias("i"), x.alias("l"))), lambda x: x["l"] == "unsupported"), lambda x: x["i"])
    rows = rows.withColumns({"claims_total": F.size("labels"), "supported_ratio": share("supported"), "unsupported_ratio": share("unsupported"), "bad": bad})
    rows = rows.withColumn("uncertain_ratio", F.when(F.col("claims_total") == 0, 1.0).otherwise(F.size(F.filter("labels", lambda x: ~x.isin("supported", "unsupported"))) / F.greatest(F.lit(1), F.size("labels"))))
    text = F.when(F.col("unsupported_ratio") > 0.40, F.concat(F.lit("Evidence is partially conflicting or insufficient for parts of this answer. "), T.strip(F.col("answer"))))
    text = text.when((F.size("bad") > 0) & (F.size("bad") <= 2), T.prune(F.col("answer"), F.col("bad"))).otherwise(F.col("answer"))
    return rows.select("query_id", text.alias("answer"), "labels", "claims_total", "supported_ratio", "unsupported_ratio", "uncertain_ratio")


def cautioned(text: Column, supported: Column, confidence_: Column, settings: Settings | None = None) -> Column:
    """A caution before answers with little support (TX35)."""
    note = "The available evidence supports only part of the answer. I may be missing additional clips or stronger corroboration.\n\n"
    return F.when((supported < (settings or Settings()).min_supported) | (confidence_ < 0.45), T.strip(F.concat(F.lit(note), text))).otherwise(text)


def answerable(queries: DataFrame, ranked: DataFrame, settings: Settings | None = None) -> DataFrame:
    """queries and enough: whether there is evidence and the best of it reaches the least score (FLT15)."""
    best = ranked.groupBy("query_id").agg(F.max("final_score").alias("best"))
    return queries.join(best, "query_id", "left").withColumn("enough", F.coalesce(F.col("best") >= (settings or Settings()).min_evidence, F.lit(False))).drop("best")


def uncertainty(query: Column) -> Column:
    return F.concat(F.lit("I could not find enough reliable evidence to answer: "), query)


def answer(queries: DataFrame, hits: DataFrame, segments: DataFrame, videos: DataFrame, generate, registry: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Q6, the answer service: answer, context, confidence and band per query (query_id, query, intent).

    generate: a hook from a DataFrame with query and context to one with the model's raw text in `raw` (hooks.echo, or a
    model). registry: video_name and url, a configuration of bounded size.
    """
    s = settings or Settings()
    ranked = rerank(hits, queries, videos, s)
    blocks = evidence(ranked, segments, s.context_tokens)
    rows = answerable(queries.select("query_id", "query"), ranked, s).join(context(blocks), "query_id", "left").join(confidence(queries, blocks), "query_id", "left")
    rows = generate(rows).withColumn("generated", T.thoughts_and_answer(F.col("raw"))["answer"])
    text = F.col("generated")
    if registry is not None:
        names = registry.agg(F.collect_list(F.struct(F.col("video_name").alias("name"), "url")).alias("names"))
        rows = rows.crossJoin(F.broadcast(names))
        text = T.inject_urls(text, F.col("names"))
    return rows.select("query_id", F.when(F.col("enough"), text).otherwise(uncertainty(F.col("query"))).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.when(F.col("enough"), F.col("confidence")).otherwise(0.2).alias("confidence"), F.when(F.col("enough"), F.col("band")).alias("band"), "enough")


def multiple_choice(rows: DataFrame, complete, tries: int = 3) -> DataFrame:
    """Q12: rows (query_id, prompt) with answer and explanation of the model's JSON, asked again while it has not both; No Content where it never has.

    Each try's answers are written before the next one, so that no row is asked again by a later try's plan.
    """
    kind = "Answer string, Explanation string"
    left, done = rows, None
    for _ in range(tries):
        parsed = shared.materialize(complete(left).select("query_id", F.from_json(T.located_json(F.col("raw")), kind).alias("j")), "choices")
        good = parsed.where("j.Answer is not null and j.Explanation is not null").select("query_id", F.col("j.Answer").alias("answer"), F.col("j.Explanation").alias("explanation"))
        done = good if done is None else done.unionByName(good)
        left = left.join(good.select("query_id"), "query_id", "left_anti")
    return done.unionByName(left.select("query_id", F.lit("No Content").alias("answer"), F.lit("").alias("explanation")))
