"""Driver contract."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "line" in df.columns


INVENTORY = """metadata_scan page_links crawl_topics crawled_metadata metadata_collection metadata_sink store_scan
store_append store_overwrite index_io store_count default_fill metadata_overlay final_difficulty search_summary
problem_listing expectations near_dup_pairs first_duplicate dedupe_gate greedy_dedupe assemble_records
search_query case_results postings tag_jaccard case_verdicts run_summary difficulty_score saved_count assign_ids
shuffle_order generation_limit retry_first_success search_batch normalize_text normalize_word index_terms
normalize_tags sequence_ratio weighted_similarity is_duplicate constraint_score topic_score complexity_score
prior_score difficulty_class xp_award render_prompts clean_llm_json parse_or_fallback mock_problems
mock_components case_flatten case_match stream_gate stream_index llm_generate generation_run
generation_counters metadata_rejects llm_generate_once expectations_stored""".split()


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_inventory_is_registered():
    assert set(INVENTORY) - set(E.queries()) == set()
