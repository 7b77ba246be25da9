
from __future__ import annotations

import datetime
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixtures as fx
from vecatlas.functions import display, text as text_functions
from vecatlas.functions.paths import is_image_path
from vecatlas.functions.vectors import normalize
from vecatlas.operators import catalog as cat
from vecatlas.operators.cells import bounded_search, build_cell_index, probed_search
from vecatlas.operators.digests import diff_by_digest, directory_digests, outermost_unchanged
from vecatlas.operators.encode import HashingEncoder, encode, encode_texts
from vecatlas.operators.export import export_manifest
from vecatlas.operators.hits import resized, sorted_by, with_paths, with_row_ids
from vecatlas.operators.images import IMAGENET_MEAN, IMAGENET_STD, image_metadata, image_tensors
from vecatlas.operators.neighbour_graph import graph_neighbours
from vecatlas.operators.paths import register_roots, unregister_roots
from vecatlas.operators.quantize import pq_search, train_codebooks
from vecatlas.operators.topk import single_query_topk, topk_search
from vecatlas.operators.wordpiece import ids_to_tokens, model_input, wordpiece
from vecatlas.plans import search as plans
from vecatlas.plans.index import KeptIndex
from vecatlas.plans.sync import rebuild, sync, unregister
from vecatlas.session import materialize, scratch_path
from vecatlas.sources import logs, sinks
from vecatlas.sources.commitlog import CommitLog, deletes, puts
from vecatlas.sources.files import list_files, list_inventory
from vecatlas.sources.snapshots import read_catalog_array, read_catalog_json, write_catalog_array, write_catalog_json
from vecatlas.sources.vocabulary import read_vocabulary, vocabulary_size
from vecatlas.streaming.ingest import apply_changes, start_ingest
from vecatlas.streaming.queries import start_search
from vecatlas.streaming.standing import StandingQueries

try:  # the operators for training data are optional
    import corpus_pipeline
    from vecatlas.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "vecatlas.llm"):
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

K = 10
CELLS = 16
NOW = datetime.date(2024, 1, 31)
_FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _score(digits: int = 4):
    """The score with few digits; cosine distances have ten, so the decimal value is exact."""
    exact = F.col("score").cast("decimal(20,8)" if digits == 4 else "decimal(20,14)")
    return F.round(exact, digits).cast("double").alias("score")


def _hit_columns(hits: DataFrame, digits: int = 4) -> DataFrame:
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "slot", "path", _score(digits)
    )


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_columns(plans.search(fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), K))


def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = plans.search(fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), K, "l2")
    return _hit_columns(hits, 6)


def knn_single_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of the table as the only query."""
    parts = fx.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("i").agg(F.avg("x").alias("x"))
    target = [r["x"] for r in means.orderBy("i").collect()]
    hits = single_query_topk(fx.gallery_vectors(spark, sf_dir), target, K)
    return hits.select("slot", F.round("score", 4).alias("score"))


def _cell_index(spark: SparkSession, sf_dir: str, metric: str):
    path = scratch_path(spark, "cells")
    return build_cell_index(fx.gallery_vectors(spark, sf_dir), path, CELLS, metric)


def _cell_join(metric: str, digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = bounded_search(_cell_index(spark, sf_dir, metric), fx.vector_queries(spark, sf_dir), K)
        return _hit_columns(with_paths(hits, fx.gallery_vectors(spark, sf_dir)), digits)

    return run


def knn_ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _cell_index(spark, sf_dir, "cosine")
    hits = probed_search(index, fx.vector_queries(spark, sf_dir), K, CELLS)
    return _hit_columns(with_paths(hits, fx.gallery_vectors(spark, sf_dir)))


def knn_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact hits that each number of probed cells finds; the cells' centres are the labels' mean vectors."""
    vectors, asked = fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    parts = fx.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("center"))
    centers = np.array([r["center"] for r in means.orderBy("label").collect()])  # a row per label
    index = build_cell_index(vectors, scratch_path(spark, "cells"), len(centers), "cosine", centers=centers)
    exact = materialize(topk_search(vectors, asked, K), "exact").select("query_id", "slot")
    runs = [
        _found(exact, probed_search(index, asked, K, n)).agg(F.round(F.avg("hit"), 6).alias("recall"))
        .select(F.lit(n).alias("nprobe"), "recall")
        for n in (1, 4, 10)
    ]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def _found(exact: DataFrame, hits: DataFrame) -> DataFrame:
    """The exact hits, with ``hit`` 1.0 where another search has them too."""
    both = exact.join(hits.select("query_id", "slot", F.lit(1.0).alias("_hit")), ["query_id", "slot"], "left")
    return both.withColumn("hit", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def _enough(spark: SparkSession, sf_dir: str, exact: DataFrame, hits: DataFrame) -> DataFrame:
    """Per label of the query: its queries, their exact hits, and whether a search finds 90 % of them."""
    labels = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return _found(exact.select("query_id", "slot"), hits).join(labels, "query_id").groupBy("label").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("hits"), (F.avg("hit") >= 0.9).alias("enough"))


def knn_pq_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query by codes of product quantisation; reranking all candidates is exact."""
    vectors, asked = fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    books = train_codebooks(vectors, rounds=2)
    hits = pq_search(books, books.encode(vectors), vectors, asked, K, refine=vectors.count())
    return _hit_columns(with_paths(hits, vectors))


def knn_pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with the default number of reranked candidates against the exact search."""
    vectors, asked = fx.gallery_vectors(spark, sf_dir).select("slot", "embedding"), fx.vector_queries(spark, sf_dir)
    # Read once per round and search; a file with one row group would be one task each time.
    tasks = max(spark.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions())
    vectors = materialize(vectors.repartition(tasks), "vectors")
    books = train_codebooks(vectors)
    codes = materialize(books.encode(vectors), "codes")
    return _enough(spark, sf_dir, topk_search(vectors, asked, K), pq_search(books, codes, vectors, asked, K))


def knn_graph_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refined graph's neighbours of every live vector against the exact ones."""
    vectors = materialize(fx.gallery_vectors(spark, sf_dir).select("slot", "embedding"), "vectors")
    asked = vectors.select(F.col("slot").alias("query_id"), "embedding")
    return _enough(spark, sf_dir, topk_search(vectors, asked, K), graph_neighbours(vectors, K))


def knn_after_directory_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    gallery = fx.gallery(spark, sf_dir)
    gone = cat.remove_directories(gallery, fx.derived(spark, sf_dir, fx.GALLERY_REMOVED))
    left = fx.gallery_vectors(spark, sf_dir).join(gone.select("slot"), "slot", "left_anti")
    return _hit_columns(plans.search(left, fx.vector_queries(spark, sf_dir), K))


def knn_existing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = fx.derived(spark, sf_dir, fx.GALLERY_LISTING)
    hits = plans.search(fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), K, listing=listing)
    return _hit_columns(hits)


def _displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = fx.derived(spark, sf_dir, fx.GALLERY_LISTING)
    return plans.search(
        fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), K, listing=listing, display=True
    )


def search_result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _displayed(spark, sf_dir).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "path", "row_id", "size_text",
        "modified_text", _score(),
    )


def search_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _displayed(spark, sf_dir).select("query_id", "path", "score_text")


def search_repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that share a path (here: their directory) get ids of their own."""
    hits = plans.search(fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), K)
    named = with_row_ids(hits.withColumn("path", F.regexp_replace("path", "/[^/]*$", "")))
    return named.select("query_id", F.col("rank").cast("long").alias("rank"), "row_id")


def _sorted(column: str, descending: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sorted_by(_displayed(spark, sf_dir), column, descending).select(
            "query_id", F.col("position").cast("long").alias("position"), "path"
        )

    return run


def search_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = plans.search(fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 30)
    return _hit_columns(resized(kept, K))


def _normalized(legacy: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        unit = fx.table(spark, sf_dir, "embeddings").select(
            "vec_id", normalize(_scaled(F.col("embedding")), legacy).alias("unit")
        )
        return unit.select("vec_id", F.posexplode("unit").alias("pos", "x")).select(
            "vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
        )

    return run


def _scaled(vector):
    """Longer vectors with some zero components."""
    return F.transform(vector, lambda x: F.when(x > 0.2, F.lit(0.0)).otherwise(x.cast("double") * 3.0))


def catalog_live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.live_count(fx.catalog(spark, sf_dir))


def result_count_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.result_count(fx.catalog(spark, sf_dir), 100)


def catalog_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.changed_files(fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.LISTING))


def catalog_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.new_files(fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.LISTING))


def catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.missing_files(
        fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.LISTING), fx.derived(spark, sf_dir, fx.USER_ROOTS)
    )


def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = cat.diff(fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.LISTING))
    return changes.withColumn("slot", F.coalesce("slot", F.lit(-1).cast("long")))


def catalog_diff_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = diff_by_digest(fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.LISTING))
    return changes.withColumn("slot", F.coalesce("slot", F.lit(-1).cast("long")))


def catalog_unchanged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an even number have changed nothing."""
    even = F.regexp_extract("path", "^/lib/u([0-9]+)/", 1).cast("long") % 2 == 0
    old = materialize(cat.live_rows(fx.catalog(spark, sf_dir)).select("path", "size"), "old")
    new = old.filter(even).unionByName(fx.derived(spark, sf_dir, fx.LISTING).select("path", "size").filter(~even))
    return outermost_unchanged(directory_digests(old), directory_digests(new))


def catalog_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.work_list(fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.LISTING))


def catalog_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.existing_only(cat.live_rows(fx.catalog(spark, sf_dir)), fx.derived(spark, sf_dir, fx.LISTING))


def _after_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fx.catalog(spark, sf_dir)
    return cat.tombstone(state, cat.missing_files(state, fx.derived(spark, sf_dir, fx.LISTING)))


def catalog_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_missing(spark, sf_dir)


def catalog_assign_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = materialize(_after_missing(spark, sf_dir), "state")
    new = cat.new_files(state, fx.derived(spark, sf_dir, fx.LISTING))
    return cat.assign_slots(new, state).select("slot", "path")


def catalog_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.densify(cat.live_rows(fx.catalog(spark, sf_dir)))


def _log(spark: SparkSession) -> CommitLog:
    return CommitLog(spark, scratch_path(spark, "atlas"))


def _synced(spark: SparkSession, sf_dir: str) -> CommitLog:
    log = _log(spark)
    state = materialize(fx.catalog(spark, sf_dir), "state")
    log.append(puts(state.filter("live")).unionByName(deletes(state.filter("not live"))), "sync-0")
    sync(log, fx.derived(spark, sf_dir, fx.LISTING), fx.derived(spark, sf_dir, fx.USER_ROOTS), "sync-1")
    return log


def catalog_after_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).catalog().filter("live").select("slot", "path", "size")


def catalog_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _synced(spark, sf_dir)
    log.compact()
    log.compact()
    return log.catalog().filter("live").select("slot", "path", "size")


def search_after_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through the commit log: all committed, some deleted, the log folded, some replaced, then searched."""
    log, vectors = _log(spark), fx.gallery_vectors(spark, sf_dir)
    log.append(puts(vectors), "sync-0")
    removed = fx.derived(spark, sf_dir, fx.GALLERY_REMOVED)
    log.append(deletes(cat.remove_directories(log.catalog(), removed)), "sync-1")
    log.compact()
    turned = log.vectors().filter(F.element_at("embedding", 2) > 0.1)
    log.append(puts(turned.withColumn("embedding", F.transform("embedding", lambda x: -x))), "sync-2")
    return _hit_columns(plans.log_search(log, fx.vector_queries(spark, sf_dir), K))


def search_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept beside the log through deletes and replaced vectors, then searched exactly from its cells."""
    log, vectors = _log(spark), fx.gallery_vectors(spark, sf_dir)
    kept = KeptIndex(log, scratch_path(spark, "kept"), CELLS)
    log.append(puts(vectors), "sync-0")
    kept.refresh()
    log.append(deletes(cat.remove_directories(log.catalog(), fx.derived(spark, sf_dir, fx.GALLERY_REMOVED))), "sync-1")
    kept.refresh()
    turned = log.vectors().filter(F.element_at("embedding", 2) > 0.1)
    log.append(puts(turned.withColumn("embedding", F.transform("embedding", lambda x: -x))), "sync-2")
    kept.refresh()
    return _hit_columns(kept.search(fx.vector_queries(spark, sf_dir), K))


def standing_topk_after_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries stand while the log takes new, deleted, replaced and returning vectors; results follow from the changes."""
    log, vectors, asked = _log(spark), fx.gallery_vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    standing = StandingQueries(log, asked, scratch_path(spark, "standing"), K)
    removed = cat.remove_directories(fx.gallery(spark, sf_dir), fx.derived(spark, sf_dir, fx.GALLERY_REMOVED))
    left = materialize(vectors.join(removed.select("slot"), "slot", "left_anti"), "left")
    turned = left.filter(F.element_at("embedding", 2) > 0.1).withColumn("embedding", F.transform("embedding", lambda x: -x))
    log.append(puts(vectors.filter(F.element_at("embedding", 3) > -0.1)), "sync-0")
    standing.refresh()
    log.append(puts(vectors.filter(F.element_at("embedding", 3) <= -0.1)), "sync-1")
    standing.refresh()
    log.append(deletes(removed), "sync-2")
    standing.refresh()
    log.append(puts(turned), "sync-3")
    return _hit_columns(with_paths(standing.refresh(), log.catalog()))


def knn_cells_after_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells keep up with deletes and replaced vectors; probing all of them is exact."""
    index, vectors = _cell_index(spark, sf_dir, "cosine"), fx.gallery_vectors(spark, sf_dir)
    gone = cat.remove_directories(fx.gallery(spark, sf_dir), fx.derived(spark, sf_dir, fx.GALLERY_REMOVED))
    index.apply(gone.select("slot", F.lit(None).cast("array<float>").alias("embedding")), 1)
    turned = vectors.filter(F.element_at("embedding", 2) > 0.1).join(gone.select("slot"), "slot", "left_anti")
    index.apply(turned.select("slot", F.transform("embedding", lambda x: -x).alias("embedding")), 2)
    hits = probed_search(index, fx.vector_queries(spark, sf_dir), K, CELLS)
    return _hit_columns(with_paths(hits, vectors))


def catalog_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _synced(spark, sf_dir)
    listing, roots = fx.derived(spark, sf_dir, fx.LISTING), fx.derived(spark, sf_dir, fx.USER_ROOTS)
    rebuild(log, listing, roots, "sync-2")
    return log.catalog().select("slot", "path", "size")


def catalog_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots removed from a synced catalog."""
    log = _synced(spark, sf_dir)
    unregister(
        log, fx.derived(spark, sf_dir, fx.USER_ROOTS), fx.derived(spark, sf_dir, fx.REMOVED_ROOTS),
        fx.derived(spark, sf_dir, fx.LISTING), "remove-0",
    )
    return log.catalog().filter("live").select("path", "size")


def catalog_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "catalog-json")
    write_catalog_json(fx.catalog(spark, sf_dir), path)
    return read_catalog_json(spark, path)


def catalog_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as one array on one line, written and read by many tasks."""
    path = scratch_path(spark, "catalog-array")
    write_catalog_array(cat.densify(fx.catalog(spark, sf_dir)), path)
    return read_catalog_array(spark, path)


def catalog_remove_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.remove_directories(fx.catalog(spark, sf_dir), fx.derived(spark, sf_dir, fx.REMOVED_ROOTS))


def roots_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_roots(
        fx.derived(spark, sf_dir, fx.HOST_ROOTS), fx.derived(spark, sf_dir, fx.PAGE_ROOTS)
    )


def roots_unregister(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unregister_roots(
        fx.derived(spark, sf_dir, fx.USER_ROOTS), fx.derived(spark, sf_dir, fx.REMOVED_ROOTS)
    )


def tokens_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text_functions.basic_tokens(F.col("text"))
    return fx.documents(spark, sf_dir).select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def tokens_wordpiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece(fx.documents(spark, sf_dir), "doc_id", "text", fx.vocabulary(spark, sf_dir))
    return pieces.select("doc_id", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("ids"))


def tokens_wordpiece_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken for a vocabulary beyond the broadcast bound."""
    pieces = wordpiece(
        fx.documents(spark, sf_dir), "doc_id", "text", fx.vocabulary(spark, sf_dir), max_broadcast_tokens=0
    )
    return pieces.select("doc_id", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("ids"))


def model_input_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = fx.vocabulary(spark, sf_dir)
    rows = model_input(wordpiece(fx.documents(spark, sf_dir), "doc_id", "text", vocabulary), vocabulary)
    return rows.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


def tokens_from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = fx.vocabulary(spark, sf_dir)
    ids = wordpiece(fx.documents(spark, sf_dir), "doc_id", "text", vocabulary).drop("text")
    named = ids_to_tokens(ids, "doc_id", "token_ids", vocabulary)
    return named.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tokens_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text_functions.basic_tokens(F.col("text"))
    return fx.documents(spark, sf_dir).select("doc_id", text_functions.tokens_to_string(tokens).alias("text"))


def vocab_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every conversation as one vocabulary line, repeats included."""
    words = fx.table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[ \n]+")).alias("value"))
    path = scratch_path(spark, "vocabulary")
    words.orderBy("value").write.text(path)
    return read_vocabulary(spark, path)


def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_size(fx.vocabulary(spark, sf_dir))


def _rewritten(legacy: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = fx.derived(spark, sf_dir, fx.KEYWORDS)
        return asked.select("query_id", text_functions.rewrite_prompt(F.col("text"), legacy).alias("prompt"))

    return run


def text_search_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as items and whole benchmark passages as queries, both by windows; the hashing stand-in as the model."""
    vocabulary, encoder = fx.vocabulary(spark, sf_dir), HashingEncoder(64)
    items = encode_texts(fx.documents(spark, sf_dir), "doc_id", "text", vocabulary, encoder, windows=True)
    vectors = materialize(
        items.select(F.col("doc_id").alias("slot"), F.concat(F.lit("/doc/"), "doc_id").alias("path"), "embedding"),
        "vectors",
    )
    hits = plans.window_search(vectors, fx.derived(spark, sf_dir, fx.KEYWORDS), vocabulary, encoder, K)
    return _hit_columns(hits)


def _retained(legacy: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logs.retain(fx.derived(spark, sf_dir, fx.LOG_LINES), NOW, legacy)

    return run


def log_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs.parse(fx.derived(spark, sf_dir, fx.LOG_LINES))
    return lines.groupBy(F.to_date("ts").cast("string").alias("day"), "message").agg(
        F.count(F.lit(1)).alias("lines")
    )


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_manifest(fx.derived(spark, sf_dir, fx.EXPORTED)).select("src_path", "target_name")


def export_names_beside_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, taken = fx.derived(spark, sf_dir, fx.EXPORTED), fx.derived(spark, sf_dir, fx.EXPORT_TAKEN)
    return export_manifest(sources, taken).select("src_path", "target_name")


def export_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, each tenth one missing, copied into one folder; names clash."""
    folder, docs = scratch_path(spark, "export"), fx.documents(spark, sf_dir)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt"))
    files = docs.filter("doc_id % 10 <> 0").select(name.alias("name"), F.col("text").cast("binary").alias("content"))
    materialize(sinks.write_files(files, f"{folder}/from"), "written")
    sources = docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit(f"{folder}/from/"), name).alias("src_path"))
    copies = materialize(sinks.export_copies(export_manifest(sources), f"{folder}/to"), "copied")
    return copies.select(F.replace("src_path", F.lit(f"{folder}/from/"), F.lit("")).alias("src_path"), "target_name", "ok", "bytes")


def listing_from_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = list_inventory(fx.derived(spark, sf_dir, fx.INVENTORY), fx.derived(spark, sf_dir, fx.INVENTORY_ROOTS))
    return found.select("path", "size", F.col("modified").cast("string").alias("modified"))


def listing_of_written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files in a folder per source and language, and the folders listed."""
    folder, docs = scratch_path(spark, "listed"), fx.table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".png")))
    materialize(sinks.write_files(docs.select(name.alias("name"), F.col("text").cast("binary").alias("content")), folder), "written")
    found = list_files(spark, [folder])
    return found.select(F.regexp_replace("path", r"^.*/(?=[^/]+/[^/]+/[^/]+$)", "").alias("path"), "size")


def listing_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derived(spark, sf_dir, fx.MIXED_FILES).filter(is_image_path(F.col("path")))


def size_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derived(spark, sf_dir, fx.LISTING).select(
        "path", display.size_text(F.col("size")).alias("size_text"), display.path_id(F.col("path")).alias("row_id")
    )


_WEEKS = (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01"))


def _ingested(spark: SparkSession, sf_dir: str, weeks) -> DataFrame:
    """The change feed as a stream of files, each path in one file a week."""
    feed = fx.derived(spark, sf_dir, fx.FEED)
    folder, log = scratch_path(spark, "feed"), _log(spark)
    for start, end in weeks:
        week = feed.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
        week.repartition(2, "path").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    start_ingest(log, stream, scratch_path(spark, "ingest")).awaitTermination()
    return log.catalog().filter("live").select("path", "size")


def ingest_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, _WEEKS)


def ingest_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks arrive in reverse, so almost every change of the second and third batch comes late."""
    return _ingested(spark, sf_dir, reversed(_WEEKS))


def ingest_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every third path fail in the first two batches and succeed later without coming again."""
    feed, log = fx.derived(spark, sf_dir, fx.FEED), _log(spark)
    tries = iter((True, True, False, False))

    def encode_work(work: DataFrame) -> DataFrame:
        broken = (F.length("path") % 3 == 0) & F.lit(next(tries))
        return work.withColumn("embedding", F.when(~broken, F.array(F.col("size").cast("float"))))

    for n, (start, end) in enumerate(_WEEKS):
        week = feed.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
        apply_changes(log, week, f"stream-{n}", encode_work)
        log.compact()
    return log.vectors().select("path", "size", F.element_at("embedding", 1).cast("double").alias("first"))


def query_stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries as a stream of several files."""
    asked = fx.vector_queries(spark, sf_dir)
    folder, out = scratch_path(spark, "asked"), scratch_path(spark, "answers")
    asked.repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    start_search(
        stream, lambda: fx.gallery_vectors(spark, sf_dir), out, scratch_path(spark, "search"), K
    ).awaitTermination()
    return _hit_columns(spark.read.parquet(out))


def image_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_metadata(fx.pictures(spark, sf_dir))


def _tensor_rows(tensors: DataFrame) -> DataFrame:
    return tensors.select("vec_id", F.posexplode("tensor").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 4).alias("x")
    )


def image_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures at the model's own size: channel order, alpha and scaling of values."""
    return _tensor_rows(image_tensors(fx.pictures(spark, sf_dir), 4))


def image_tensor_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensor_rows(image_tensors(fx.pictures(spark, sf_dir), 8))


def image_tensor_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensor_rows(image_tensors(fx.pictures(spark, sf_dir), 3))


def image_embedding_second_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second model configuration: other mean and deviation, vectors not normalised."""
    tensors = image_tensors(fx.pictures(spark, sf_dir), 4, IMAGENET_MEAN, IMAGENET_STD)
    vectors = encode(tensors, "tensor", (3, 4, 4), "float32", fx.PlaneMeans(), normalization=False)
    return vectors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 3).alias("x")
    )


def image_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tensors = image_tensors(fx.pictures(spark, sf_dir), 4)
    vectors = encode(tensors, "tensor", (3, 4, 4), "float32", fx.PlaneMeans())
    return vectors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 3).alias("x")
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: exact cosine neighbours of every vector."""
    return knn_cosine_topk(spark, _FLAGSHIP_DIR)


def queries() -> dict[str, Query]:
    extra = {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}
    return {
        **extra,
        "knn_cosine_topk": knn_cosine_topk,
        "knn_l2_topk": knn_l2_topk,
        "knn_single_query": knn_single_query,
        "knn_cell_join_cosine": _cell_join("cosine", 4),
        "knn_cell_join_l2": _cell_join("l2", 6),
        "knn_ivf_full_probe": knn_ivf_full_probe,
        "knn_ivf_recall": knn_ivf_recall,
        "knn_pq_rerank": knn_pq_rerank,
        "knn_pq_recall": knn_pq_recall,
        "knn_graph_self": knn_graph_self,
        "knn_after_directory_removal": knn_after_directory_removal,
        "knn_existing_only": knn_existing_only,
        "search_after_sync": search_after_sync,
        "knn_cells_after_upserts": knn_cells_after_upserts,
        "search_kept_index": search_kept_index,
        "standing_topk_after_commits": standing_topk_after_commits,
        "search_result_columns": search_result_columns,
        "search_score_text": search_score_text,
        "search_repeated_paths": search_repeated_paths,
        "search_sorted_by_size": _sorted("size", False),
        "search_sorted_by_score": _sorted("score", True),
        "search_sorted_by_modified": _sorted("modified", False),
        "search_resized": search_resized,
        "normalize_vectors": _normalized(False),
        "normalize_vectors_legacy": _normalized(True),
        "catalog_live_count": catalog_live_count,
        "result_count_k": result_count_k,
        "catalog_changed": catalog_changed,
        "catalog_new": catalog_new,
        "catalog_missing": catalog_missing,
        "catalog_diff": catalog_diff,
        "catalog_diff_by_digest": catalog_diff_by_digest,
        "catalog_unchanged_trees": catalog_unchanged_trees,
        "catalog_existing": catalog_existing,
        "catalog_worklist": catalog_worklist,
        "catalog_tombstoned": catalog_tombstoned,
        "catalog_assign_slots": catalog_assign_slots,
        "catalog_densify": catalog_densify,
        "catalog_after_sync": catalog_after_sync,
        "catalog_after_compaction": catalog_after_compaction,
        "catalog_rebuilt": catalog_rebuilt,
        "catalog_unregistered": catalog_unregistered,
        "catalog_json_lines": catalog_json_lines,
        "catalog_json_array": catalog_json_array,
        "catalog_remove_directories": catalog_remove_directories,
        "roots_register": roots_register,
        "roots_unregister": roots_unregister,
        "tokens_basic": tokens_basic,
        "tokens_wordpiece_ids": tokens_wordpiece_ids,
        "tokens_wordpiece_by_join": tokens_wordpiece_by_join,
        "model_input_rows": model_input_rows,
        "tokens_from_ids": tokens_from_ids,
        "tokens_to_string": tokens_to_string,
        "vocab_load": vocab_load,
        "vocab_size": vocab_size,
        "query_rewrite": _rewritten(False),
        "query_rewrite_legacy": _rewritten(True),
        "text_search_hashed": text_search_hashed,
        "log_retention": _retained(False),
        "log_retention_legacy": _retained(True),
        "log_parsed": log_parsed,
        "export_names": export_names,
        "export_names_beside_taken": export_names_beside_taken,
        "export_copies": export_copies,
        "listing_from_inventory": listing_from_inventory,
        "listing_of_written_files": listing_of_written_files,
        "listing_accepted": listing_accepted,
        "size_display": size_display,
        "ingest_latest_state": ingest_latest_state,
        "ingest_out_of_order": ingest_out_of_order,
        "ingest_with_failures": ingest_with_failures,
        "query_stream_topk": query_stream_topk,
        "image_size_report": image_size_report,
        "image_tensor": image_tensor,
        "image_tensor_resized": image_tensor_resized,
        "image_tensor_shrunk": image_tensor_shrunk,
        "image_embedding": image_embedding,
        "image_embedding_second_model": image_embedding_second_model,
    }


def oracle_sql() -> dict[str, str]:
    from oracles import ORACLES

    extra = dict(llm.ORACLE_SQL) if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**ORACLES, **extra}
