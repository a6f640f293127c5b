"""Registered queries: one callable per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame whose columns are all
scalar (arrays are rendered as joined strings) so the oracle can compare
values engine-independently. Column names match ``quarry.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import mock, prompts, scoring, similarity, text
from quarry.operators import generation, generation_run, ids, ledger, neardup, pages, quality, runs, search, verdicts
from quarry.plans import views
from quarry.session import scratch_dir
from quarry.sources import metadata, store
from quarry.streaming import gate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SEARCH_TEXT = "red wid"


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- shared views

def p_view(spark, sf):
    return views.problems_from_part(views.table(spark, sf, "part"))


def pf_view(spark, sf):
    """P records with analysed difficulty and XP (what the store would hold)."""
    return scoring.with_final_difficulty(p_view(spark, sf))


def d_view(spark, sf):
    return views.problems_from_documents(views.table(spark, sf, "documents"))


def _tags_text(c="tags"):
    return F.array_join(F.col(c), ", ")


# ------------------------------------------------------------ index & search

_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark, sf):
    """The written index of the P records: built once an application, then read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        base = scratch_dir(spark, "search-index")
        pf = pf_view(spark, sf)
        search.write_index(search.postings(pf), search.search_summary(pf), base)
        _INDEXES[key] = base
    return search.open_index(spark, _INDEXES[key])


@register("search_query")
def q_search_query(spark, sf):
    post, summary, dictionary = stored_index(spark, sf)
    hits = search.search_query(spark, post, summary, SEARCH_TEXT, dictionary)
    return search.result_lines(hits).select(
        "id", "title", "difficulty", "xp", "topic", _tags_text().alias("tags"),
        "time_complexity", "space_complexity", "line")


@register("postings")
def q_postings(spark, sf):
    return search.postings(pf_view(spark, sf))


@register("index_terms")
def q_index_terms(spark, sf):
    t = search.index_terms()
    return pf_view(spark, sf).select("id", F.array_join(F.array_sort(t), " ").alias("terms"),
                                     F.size(t).alias("n_terms"))


@register("search_summary")
def q_search_summary(spark, sf):
    s = search.search_summary(pf_view(spark, sf))
    return s.select("id", "title", "difficulty", _tags_text().alias("tags"), "topic", "xp",
                    "time_complexity", "space_complexity")


@register("problem_listing")
def q_problem_listing(spark, sf):
    return search.problem_listing(pf_view(spark, sf))


@register("search_batch")
def q_search_batch(spark, sf):
    queries = (views.table(spark, sf, "part").select(F.col("p_name").alias("query")).distinct()
               .withColumn("query_id", F.col("query")))
    post, summary, dictionary = stored_index(spark, sf)
    hits = search.search_batch(post, summary, queries, dictionary=dictionary)
    return hits.select("query_id", "id", "title")


# ------------------------------------------------------------------ text core

@register("normalize_text")
def q_normalize_text(spark, sf):
    docs = views.table(spark, sf, "documents")
    n = text.normalize_text("text")
    return docs.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_len"))


@register("normalize_word")
def q_normalize_word(spark, sf):
    p = p_view(spark, sf)
    return p.select("id", text.normalize_word("title").alias("title_word"),
                    F.array_join(F.transform("tags", lambda t: text.normalize_word(t)), "|").alias("tag_words"),
                    text.normalize_word("time_complexity").alias("time_word"))


@register("normalize_tags")
def q_normalize_tags(spark, sf):
    d = d_view(spark, sf)
    tags = F.array(F.col("topic"), F.lit(" "), F.lit(""), F.upper(F.col("tags")[0]),
                   F.lit(None).cast("string"))
    return d.select("id", F.array_join(text.normalize_tags(tags), "|").alias("tag_set"))


@register("tag_jaccard")
def q_tag_jaccard(spark, sf):
    """Each P record against its predecessor in key order (an equi-join)."""
    p = p_view(spark, sf).select("seq", "id", "tags")
    prev = p.select((F.col("seq") + 1).alias("seq"), F.col("id").alias("prev_id"),
                    F.col("tags").alias("prev_tags"))
    j = p.join(prev, "seq")
    return j.select("id", "prev_id", text.tag_jaccard("tags", "prev_tags").alias("tag_similarity"))


# ------------------------------------------------------------------- scoring

@register("constraint_score")
def q_constraint_score(spark, sf):
    return p_view(spark, sf).select("id", scoring.constraint_score("constraints").alias("constraint_score"))


@register("topic_score")
def q_topic_score(spark, sf):
    return p_view(spark, sf).select("id", scoring.topic_score("tags", "topic").alias("topic_score"))


@register("complexity_score")
def q_complexity_score(spark, sf):
    return p_view(spark, sf).select(
        "id", scoring.complexity_score("time_complexity", "constraints").alias("complexity_score"))


@register("prior_score")
def q_prior_score(spark, sf):
    return p_view(spark, sf).select("id", scoring.prior_score("difficulty").alias("prior_score"))


@register("difficulty_score")
def q_difficulty_score(spark, sf):
    return pf_view(spark, sf).select("id", "difficulty_score")


@register("difficulty_class")
def q_difficulty_class(spark, sf):
    return pf_view(spark, sf).select("id", "difficulty_score", "difficulty")


@register("xp_award")
def q_xp_award(spark, sf):
    return pf_view(spark, sf).select("id", "difficulty", "xp")


@register("final_difficulty")
def q_final_difficulty(spark, sf):
    return pf_view(spark, sf).select("id", "suggested_difficulty", "difficulty", "xp", "title", "topic")


# ------------------------------------------------------------ pages -> metadata

def _g_links(spark, sf):
    return pages.page_links(views.table(spark, sf, "pages"), views.G_PATH)


def _g_collection(spark, sf):
    return pages.metadata_collection(spark, views.table(spark, sf, "pages"), views.G_PATH,
                                     keyword=views.G_KEYWORD)


def _meta_out(df):
    return df.select("file_name", "origin", "topic", "difficulty",
                     F.array_join("tags", "|").alias("tags"), "concept", "learning_objective")


@register("page_links")
def q_page_links(spark, sf):
    return _g_links(spark, sf)


@register("crawl_topics")
def q_crawl_topics(spark, sf):
    return pages.crawl_topics(_g_links(spark, sf), keyword=views.G_KEYWORD)


@register("crawled_metadata")
def q_crawled_metadata(spark, sf):
    t = pages.crawl_topics(_g_links(spark, sf), keyword=views.G_KEYWORD)
    return _meta_out(pages.crawled_metadata(t))


@register("metadata_collection")
def q_metadata_collection(spark, sf):
    return _meta_out(_g_collection(spark, sf))


@register("saved_count")
def q_saved_count(spark, sf):
    return pages.saved_count(_g_collection(spark, sf))


@register("metadata_sink")
def q_metadata_sink(spark, sf):
    """Write the collection (one folder per origin) and read it back."""
    path = scratch_dir(spark, "metadata")
    metadata.metadata_sink(_g_collection(spark, sf), path)
    back = spark.read.schema(
        "file_name string, topic string, difficulty string, tags array<string>, concept string, "
        "learning_objective string").json(path)
    return _meta_out(back)


@register("metadata_scan")
def q_metadata_scan(spark, sf):
    """The 13 baseline records as one file each, the crawled ones as files of
    many records; both layouts scanned."""
    own, many = scratch_dir(spark, "metadata-files"), scratch_dir(spark, "metadata-lines")
    collection = _g_collection(spark, sf)
    metadata.metadata_sink(collection.where("origin = 'baseline'"), own, per_record_files=True)
    metadata.metadata_sink(collection.where("origin = 'crawled'"), many)
    columns = ["file_name", "topic", "difficulty", "tags", "concept", "learning_objective"]
    back = metadata.metadata_scan(spark, own).select(*columns).unionByName(
        metadata.metadata_scan(spark, many, one_object_per_file=False).select(*columns))
    origin = F.when(F.col("file_name").startswith("metadata_baseline"), F.lit("baseline")).otherwise(
        F.lit("crawled"))
    return _meta_out(back.withColumn("origin", origin))


@register("metadata_rejects")
def q_metadata_rejects(spark, sf):
    """Metadata lines made of documents, those of every fifth cut short or with
    a field of another type: what the scan leaves out."""
    path = scratch_dir(spark, "metadata-broken")
    line = F.concat(F.lit('{"concept": "c'), F.col("doc_id"), F.lit('", "topic": "'), F.col("lang"), F.lit('"'))
    end = F.when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 3, ', "tags": 7}').otherwise("}")
    views.table(spark, sf, "documents").select(F.concat(line, end).alias("value")).write.text(path)
    bad = metadata.metadata_rejects(spark, path, one_object_per_file=False, pattern="*.txt")
    return bad.select("reason", F.md5("raw").alias("raw_md5"))


# ------------------------------------------------------- model replies as tables



def l_fallback():
    return F.struct(F.lit("").alias("text"), F.lit("und").alias("lang"))
L_SCHEMA = "text string, lang string"


def l_view(spark, sf):
    return views.responses_from_documents(views.table(spark, sf, "documents"))


@register("render_prompts")
def q_render_prompts(spark, sf):
    d = prompts.render_prompts(d_view(spark, sf))
    cols = ["id"]
    for n in prompts.TEMPLATES:
        c = F.col(f"prompt_{n}")
        cols += [F.md5(c).alias(f"{n}_md5"), F.length(c).alias(f"{n}_len")]
    return d.select(*cols)


@register("clean_llm_json")
def q_clean_llm_json(spark, sf):
    c = F.col("clean")
    return text.with_clean_llm_json(l_view(spark, sf), "response", "clean").select(
        "doc_id", F.md5(c).alias("clean_md5"), F.length(c).alias("clean_len"))


@register("parse_or_fallback")
def q_parse_or_fallback(spark, sf):
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(L_SCHEMA)
    p = generation.parse_or_fallback(l_view(spark, sf), "response", schema, l_fallback())
    return p.select("doc_id", F.col("parsed_ok").alias("parsed_ok"),
                    F.md5(F.col("parsed.text")).alias("text_md5"), F.col("parsed.lang").alias("lang"))


def _d_labels(spark, sf):
    labels = views.table(spark, sf, "labels").withColumnRenamed("doc_id", "seq")
    d = d_view(spark, sf).join(labels, "seq", "left")
    return d.withColumns({
        "difficulty": F.when(F.col("quality") == 1, F.lit("Easy")).when(F.col("quality") == 0, F.lit("Hard")),
        "concept": F.when(F.col("toxic") == 1, F.lit("Moderation")),
    })


@register("default_fill")
def q_default_fill(spark, sf):
    filled = generation.default_fill(_d_labels(spark, sf), prompts.PROBLEM_DEFAULTS)
    return filled.select("id", "topic", "difficulty", "concept",
                         F.array_join("tags", ", ").alias("tags"))


@register("metadata_overlay")
def q_metadata_overlay(spark, sf):
    """P records answered by a reply that names its own topic and level;
    the metadata wins after parsing."""
    from pyspark.sql import types as T
    p = p_view(spark, sf)
    reply = F.concat(F.lit('{"title": "'), views.json_escape(F.col("title")),
                     F.lit('", "statement": "'), views.json_escape(F.col("statement")),
                     F.lit('", "constraints": ["1 <= N <= 10"], "topic": "Other", "difficulty": "Easy"}'))
    meta = p.select("id", F.col("topic").alias("meta_topic"), F.col("tags").alias("meta_tags"),
                    F.col("difficulty").alias("meta_difficulty"),
                    F.lit(None).cast("string").alias("meta_concept"),
                    F.lit(None).cast("string").alias("meta_learning_objective"), reply.alias("reply"))
    schema = T.StructType(generation.PROBLEM_REPLY.fields + [T.StructField("topic", T.StringType()),
                                                             T.StructField("difficulty", T.StringType())])
    parsed = generation.parse_or_fallback(meta, "reply", schema, F.lit(None).cast(schema))
    out = generation.metadata_overlay(parsed.select("id", "meta_topic", "meta_tags", "meta_difficulty",
                                                    "meta_concept", "meta_learning_objective", "parsed.*"))
    return out.select("id", "title", "statement", "topic", F.array_join("tags", "|").alias("tags"),
                      "concept", "learning_objective", "difficulty",
                      F.array_join("constraints", "|").alias("constraints"))


def _mock_out(df):
    return df.select("file_name", "title", F.md5("statement").alias("statement_md5"),
                     F.array_join("constraints", "|").alias("constraints"), "input_format", "output_format",
                     F.size("examples").alias("n_examples"), "topic", "difficulty",
                     F.array_join("tags", "|").alias("tags"), "concept", "learning_objective")


@register("mock_problems")
def q_mock_problems(spark, sf):
    return _mock_out(mock.mock_problem(_g_collection(spark, sf)))


@register("mock_components")
def q_mock_components(spark, sf):
    m = mock.mock_components(_g_collection(spark, sf))
    return m.select("file_name",
                    F.array_join(F.array_sort(F.map_keys("starter_code")), "|").alias("languages"),
                    F.size("test_cases.public").alias("n_public"), F.size("test_cases.hidden").alias("n_hidden"),
                    F.size("hints").alias("n_hints"), F.col("editorial.time_complexity").alias("time_complexity"),
                    F.md5(F.col("starter_code")["python"]).alias("python_md5"))


def _length_client():
    import json

    def call(prompt: str) -> str:
        if prompt is None:
            raise ValueError("no prompt")
        return json.dumps({"n": len(prompt)})
    return call


@register("llm_generate")
def q_llm_generate(spark, sf):
    d = prompts.render_prompts(d_view(spark, sf), ["hints"])
    out = generation.generate(d.select("id", "prompt_hints"), "prompt_hints", _length_client, key_cols=["id"])
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("n", T.LongType())])
    parsed = generation.parse_or_fallback(out, "response", schema, F.struct(F.lit(-1).cast("long").alias("n")))
    return parsed.select("id", F.col("parsed.n").alias("n"), "parsed_ok")


def _moody_client():
    """Answers with the prompt's length; refuses prompts about odd thousands."""
    def call(prompt: str) -> str:
        if int(prompt.rsplit(" ", 1)[1]) % 2:
            raise ValueError("odd")
        return str(len(prompt))
    return call


@register("llm_generate_once")
def q_llm_generate_once(spark, sf):
    """One prompt for all documents of a language and size: called once each,
    over two runs of which the second finds all answers in the ledger."""
    path = scratch_dir(spark, "ledger")
    rows = views.table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("thousands of characters in "), F.col("lang"), F.lit(" "),
        F.floor(F.col("n_chars") / 1000).cast("string")).alias("prompt"))
    ledger.generate_once(rows.where("doc_id % 2 = 0"), "prompt", _moody_client, path)
    out = ledger.generate_once(rows, "prompt", _moody_client, path, wave=20)
    return out.select("doc_id", F.col("response").cast("int").alias("n"), "error")


# ------------------------------------------------------------ verdicts & gates

def _v_tables(spark, sf):
    return views.case_tables_from_lineitem(views.table(spark, sf, "lineitem"))


@register("case_flatten")
def q_case_flatten(spark, sf):
    recs = mock.mock_components(p_view(spark, sf))
    return verdicts.case_flatten(recs, "id")


@register("case_results")
def q_case_results(spark, sf):
    cases, outputs = _v_tables(spark, sf)
    return verdicts.case_results(cases, outputs).select(
        "problem_id", "case_idx", "expected", "actual", "exit_code", "timed_out", "has_output")


@register("case_match")
def q_case_match(spark, sf):
    cases, outputs = _v_tables(spark, sf)
    return verdicts.case_match(verdicts.case_results(cases, outputs)).select("problem_id", "case_idx", "match")


@register("case_verdicts")
def q_case_verdicts(spark, sf):
    cases, outputs = _v_tables(spark, sf)
    problems = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("problem_id"))
    return verdicts.case_verdicts(problems, cases, outputs)


def d_records(spark, sf):
    """D records assembled with labels, pages and offline components."""
    labels = views.table(spark, sf, "labels").withColumnRenamed("doc_id", "seq")
    pg = views.table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url")
    d = d_view(spark, sf).join(labels, "seq", "left").join(pg, "seq", "left")
    d = d.withColumns({
        "difficulty": F.when(F.col("quality") == 1, F.lit("Easy")).when(F.col("quality") == 0, F.lit("Hard")),
        "concept": F.when(F.col("url").isNotNull(), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)),
        "learning_objective": F.when(F.col("toxic") == 0, F.lit("Write a clean solution")),
        "constraints": F.array(*[F.lit(c) for c in mock.MOCK_CONSTRAINTS]),
        "input_format": F.lit(mock.INPUT_FORMAT), "output_format": F.lit(mock.OUTPUT_FORMAT),
    })
    d = mock.mock_components(d).withColumn("time_complexity", F.col("editorial.time_complexity"))
    d = scoring.with_final_difficulty(d)
    return quality.assemble_record(d)


def _record_out(df):
    return df.select("id", F.md5("title").alias("title_md5"), F.md5("statement").alias("statement_md5"),
                     "difficulty", "xp", F.array_join("tags", "|").alias("tags"), "topic", "concept",
                     "learning_objective", F.array_join("constraints", "|").alias("constraints"),
                     F.size(F.map_keys("starter_code")).alias("n_languages"),
                     F.size("test_cases.public").alias("n_public"), F.size("test_cases.hidden").alias("n_hidden"),
                     F.size("hints").alias("n_hints"), F.col("editorial.time_complexity").alias("time_complexity"))


@register("assemble_records")
def q_assemble_records(spark, sf):
    return _record_out(d_records(spark, sf))


def _broken_id(n, id):
    """Some ids without their prefix, some not unique."""
    return (F.when(n % 101 == 0, F.lit("LL-000001")).when(n % 97 == 0, F.concat(F.lit("XX"), F.substring(id, 3, 20)))
            .otherwise(F.col(id)))


def checked_records(spark, sf):
    """Records with parts broken by their number, so that every rule on
    components fails somewhere."""
    n = F.substring("id", 4, 20).cast("long") - 1
    broken = d_records(spark, sf).withColumn("_n", n)
    n = F.col("_n")
    cases = F.col("test_cases")
    broken = broken.withColumns({
        "id": _broken_id(n, "id"),
        "starter_code": F.when(n % 5 == 0, F.map_filter("starter_code", lambda k, v: k != "java")).otherwise(
            F.col("starter_code")),
        "test_cases": cases.withField("hidden", F.when(n % 7 == 0, F.slice(cases["hidden"], 1, 9)).otherwise(cases["hidden"]))
        .withField("public", F.when(n % 17 == 0, F.slice(cases["public"], 1, 0)).otherwise(cases["public"])),
        "editorial": F.col("editorial").withField("optimal", F.when(n % 13 == 0, F.lit("")).otherwise(
            F.col("editorial.optimal"))),
        "hints": F.when(n % 19 != 0, F.when(n % 11 == 0, F.slice("hints", 1, 2)).otherwise(F.col("hints"))),
        "input_format": F.when(n % 23 != 0, F.col("input_format"))}).drop("_n")
    own = views.table(spark, sf, "documents").select(F.col("doc_id").alias("n"), views.format_id(F.col("doc_id") + 1).alias("i"))
    return quality.check_expectations(broken, ids=own.select(_broken_id(F.col("n"), "i").alias("id")))


@register("expectations")
def q_expectations(spark, sf):
    return quality.expectation_summary(checked_records(spark, sf))


@register("expectations_quarantine")
def q_expectations_quarantine(spark, sf):
    _, bad = quality.split_pass_quarantine(checked_records(spark, sf))
    return bad.select("id", F.array_join("failed_rules", "|").alias("failed_rules"))


@register("expectations_stored")
def q_expectations_stored(spark, sf):
    """Documents' records against a store that holds every seventh id."""
    base = scratch_dir(spark, "stored")
    recs = d_records(spark, sf)
    store.store_append(d_view(spark, sf).where(F.col("seq") % 7 == 0), base)
    checked = quality.check_expectations(recs, ids=d_view(spark, sf).select("id"), stored=store.store_scan(spark, base))
    return checked.select("id", "rule_id_unique", "rule_id_not_stored",
                          F.array_contains("failed_rules", "id_not_stored").alias("listed"))


# ---------------------------------------------------------------- store & runs

def _two_batch_store(spark, sf):
    base = scratch_dir(spark, "store")
    recs = d_records(spark, sf)
    store.store_append(recs.where(F.col("id") < "LL-000500"), base)
    store.store_append(recs.where(F.col("id") >= "LL-000500"), base)
    return base


@register("store_append")
def q_store_append(spark, sf):
    return _record_out(store.store_scan(spark, _two_batch_store(spark, sf)))


@register("store_scan")
def q_store_scan(spark, sf):
    base = scratch_dir(spark, "store")
    store.store_append(d_records(spark, sf), base)
    return _record_out(store.store_scan(spark, base))


@register("store_overwrite")
def q_store_overwrite(spark, sf):
    base = _two_batch_store(spark, sf)
    current = store.store_scan(spark, base)
    store.store_overwrite(current.where(F.col("topic") != "en"), base)
    return _record_out(store.store_scan(spark, base))


@register("store_count")
def q_store_count(spark, sf):
    return store.store_count(spark, _two_batch_store(spark, sf))


@register("index_io")
def q_index_io(spark, sf):
    base = scratch_dir(spark, "index")
    pf = pf_view(spark, sf)
    search.write_index(search.postings(pf), search.search_summary(pf), base)
    post, summ = search.read_index(spark, base)
    # small files, many rows: no broadcast
    return post.join(summ.select("id", "title").hint("merge"), "id")


@register("assign_ids")
def q_assign_ids(spark, sf):
    existing = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    docs = views.table(spark, sf, "documents").select("doc_id", "lang")
    return ids.assign_ids(docs, ["doc_id"], store=existing).select("doc_id", "id")


SHUFFLE_SEED = "42"


@register("shuffle_order")
def q_shuffle_order(spark, sf):
    return runs.shuffle_order(p_view(spark, sf).select("id", "title"), "id", SHUFFLE_SEED)


@register("generation_limit")
def q_generation_limit(spark, sf):
    return runs.generation_limit(pf_view(spark, sf).select("id", "title", "difficulty"), "id", 10, SHUFFLE_SEED)


RUN_LIMIT = 20


def _run_attempts(spark, sf):
    """Parts as attempts, three a key in order; verdicts of the case tables."""
    cases, outputs = _v_tables(spark, sf)
    p = p_view(spark, sf)
    passed = verdicts.case_verdicts(p.select(F.col("seq").alias("problem_id")), cases, outputs).select(
        F.col("problem_id").alias("seq"), F.col("first_fail_kind").isNull().alias("valid"))
    return p.join(passed, "seq").withColumn("key", F.floor(F.col("seq") / runs.MAX_ATTEMPTS))


def _made(spark, sf):
    return generation_run.generation_run(_run_attempts(spark, sf), scratch_dir(spark, "run-store"),
                                         scratch_dir(spark, "run-index"), RUN_LIMIT)


@register("generation_run")
def q_generation_run(spark, sf):
    return _made(spark, sf).select("id", "seq", "outcome", "new_id")


@register("generation_counters")
def q_generation_counters(spark, sf):
    return generation_run.counters(_made(spark, sf))


@register("retry_first_success")
def q_retry_first_success(spark, sf):
    return runs.retry_first_success(views.attempts_from_events(views.table(spark, sf, "events")))


@register("run_summary")
def q_run_summary(spark, sf):
    return runs.run_summary(views.table(spark, sf, "events"))


# ------------------------------------------------------------------ near-dup

def _adjacent(spark, sf):
    p = p_view(spark, sf).select("seq", "id", "title", "statement", "tags")
    prev = p.select((F.col("seq") + 1).alias("seq"), F.col("id").alias("prev_id"),
                    F.col("title").alias("prev_title"), F.col("statement").alias("prev_statement"),
                    F.col("tags").alias("prev_tags"))
    return neardup.spread(p.join(prev, "seq"))


def _adjacent_scores(spark, sf):
    j = _adjacent(spark, sf)
    j = j.withColumns({"title_similarity": similarity.sequence_ratio("title", "prev_title"),
                       "statement_similarity": similarity.sequence_ratio("statement", "prev_statement"),
                       "tag_similarity": text.tag_jaccard("tags", "prev_tags")})
    return j.withColumn("weighted_similarity", similarity.weighted_similarity(
        "title_similarity", "statement_similarity", "tag_similarity"))


@register("sequence_ratio")
def q_sequence_ratio(spark, sf):
    return _adjacent_scores(spark, sf).select("id", "prev_id", "title_similarity", "statement_similarity")


@register("weighted_similarity")
def q_weighted_similarity(spark, sf):
    return _adjacent_scores(spark, sf).select("id", "prev_id", "tag_similarity", "weighted_similarity")


@register("is_duplicate")
def q_is_duplicate(spark, sf):
    s = _adjacent_scores(spark, sf)
    return s.select("id", "prev_id", similarity.is_duplicate(
        "title_similarity", "statement_similarity", "weighted_similarity").alias("is_duplicate"))


def bench_view(spark, sf):
    return views.items_from_benchmark(views.table(spark, sf, "benchmark"))


def _p_split(spark, sf):
    """P records with p_size > 25 (new) against the others (the store)."""
    p = p_view(spark, sf).join(views.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), "p_size"),
                               "seq")
    return p.where(F.col("p_size") > 25).drop("p_size"), p.where(F.col("p_size") <= 25).drop("p_size")


@register("near_dup_pairs")
def q_near_dup_pairs(spark, sf):
    new, ex = _p_split(spark, sf)
    return neardup.near_dup_pairs(new, ex)


@register("first_duplicate")
def q_first_duplicate(spark, sf):
    return neardup.first_duplicate(p_view(spark, sf))


@register("dedupe_gate_benchmark")
def q_dedupe_gate_benchmark(spark, sf):
    """Documents that are not near-duplicates of any benchmark item."""
    return neardup.dedupe_gate(d_view(spark, sf), bench_view(spark, sf)).select("id", "seq")


@register("dedupe_gate")
def q_dedupe_gate(spark, sf):
    """All other parts against a store of two keys in 101: unlike titles stay."""
    p = p_view(spark, sf)
    return neardup.dedupe_gate(p.where(F.col("seq") % 101 >= 2), p.where(F.col("seq") % 101 < 2)).select("id", "seq")


@register("greedy_dedupe")
def q_greedy_dedupe(spark, sf):
    g = neardup.greedy_dedupe(p_view(spark, sf))
    return g.where("accepted").select("id", "seq", "title")


# ------------------------------------------------------------------ streaming

STREAM_SLICES = 4


def _p_stream_source(spark, sf, name):
    src = scratch_dir(spark, name + "-src")
    p = p_view(spark, sf)
    gate.write_slices(p, src, "seq", STREAM_SLICES)
    return src, p.schema


@register("stream_gate")
def q_stream_gate(spark, sf):
    """P arriving in four files; the store ends as the greedy result."""
    src, schema = _p_stream_source(spark, sf, "gate")
    base = scratch_dir(spark, "gate-store")
    gate.stream_gate(spark, src, schema, base, scratch_dir(spark, "gate-ckpt"))
    return store.store_scan(spark, base).select("id", "title")


@register("stream_index")
def q_stream_index(spark, sf):
    src, schema = _p_stream_source(spark, sf, "index")
    # the index is built from analysed records (difficulty, XP)
    pf_src = scratch_dir(spark, "index-pf")
    pf = scoring.with_final_difficulty(spark.read.schema(schema).parquet(src))
    pf.write.parquet(pf_src)
    base = scratch_dir(spark, "index-out")
    gate.stream_index(spark, pf_src, pf.schema, base, scratch_dir(spark, "index-ckpt"))
    post, _ = gate.read_stream_index(spark, base)
    return post.select("term", "id")
