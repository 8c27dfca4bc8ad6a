"""One run from entities to routing: filter, fingerprints, candidates, edges, clusters, ranking, shadows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from windrow import embeddings
from windrow.functions.text import chunks, norm, salient
from windrow.hooks import Hooks
from windrow.operators import candidates, canonical, fingerprint, graph, lowpass, scoring, sketch
from windrow.operators.ranking import global_index
from windrow.session import materialise

_PAIR = (
    "patch_ids", "hunk_signatures", "changed_files", "salient", "text_norm", "diff_norm", "linked_issues", "soft_linked_issues", "text_embedding", "diff_embedding",
    "signature", "simhash", "winnow", "additions", "deletions",
)
METRICS = (
    "lineage", "structure", "hunk_overlap", "file_overlap", "title_salient", "hard_link", "soft_link", "semantic", "semantic_text", "minhash",
    "simhash", "winnow", "penalty", "total",
)
HUNKS = "array<struct<file_path: string, context: string, added_lines: array<string>, removed_lines: array<string>>>"
KEYS = {"hard": "linked_issues", "soft": "soft_linked_issues", "file": "changed_files", "module": "module_buckets", "band": "bands", "chunk": "chunks", "winnow": "winnow"}


@dataclass
class Report:
    filtered: DataFrame
    fingerprints: DataFrame
    edges: DataFrame
    clusters: DataFrame
    types: DataFrame
    decisions: DataFrame
    routing: DataFrame
    shadows: DataFrame
    fresh: DataFrame | None = None

    def profile(self) -> DataFrame:
        """counter, n for every stage."""
        out = None
        for name in ("filtered", "fingerprints", "edges", "types", "decisions", "routing", "shadows"):
            part = getattr(self, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
            out = part if out is None else out.unionByName(part)
        return out


def fingerprints(active: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Fingerprints with embeddings and sketches, all made in the row of the entity: nothing is shuffled but what an
    outside embedder returns. Issues have no sketches unless the settings say so."""
    s, n = cfg["similarity"], cfg["similarity"]["minhash_permutations"]
    hunks = F.col("diff_hunks") if "diff_hunks" in active.columns else F.array().cast(HUNKS)
    title, body = (F.coalesce(c, F.lit("")) for c in ("title", "body"))
    text = F.concat_ws("\n", title, body)
    diff = fingerprint.diff_text(F.col("changed_files"), F.coalesce(hunks, F.array().cast(HUNKS)))
    embedder = embeddings.provider(cfg)
    local = isinstance(embedder, embeddings.LocalHash)
    cut = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    base = fingerprint.assemble(active, *((cut(text).alias("__t"), cut(diff).alias("__d")) if local else ()))
    sketched = F.lit(s["use_advanced"]) & (F.lit(s["advanced_for_issues"]) | (F.col("lane") == "pr"))
    base = base.withColumn("__m", F.when(sketched, fingerprint.material_tokens()))
    out = base.mapInArrow(_sketches(s, cfg["embedding"].get("dims")), _sketch_schema(base, local))
    if not local:
        texts = active.select(F.col("id").alias("entity_id"), text.alias("t"), diff.alias("d"))
        for c, name in (("t", "text_embedding"), ("d", "diff_embedding")):
            out = out.join(embedder.embed(texts, "entity_id", c).select(F.col("key").alias("entity_id"), F.col("vector").alias(name)), "entity_id", "left")
    words_none = F.array().cast("array<string>")
    chunk = F.transform(sketch_chunks(F.col("simhash"), s["simhash_chunk"]), lambda c: F.concat_ws(":", c["idx"].cast("string"), c["part"].cast("string")))
    return out.withColumns({
        "salient": salient(F.col("title_tokens")),
        "text_norm": norm(F.col("text_embedding")),
        "diff_norm": norm(F.col("diff_embedding")),
        "bands": F.when(F.size("signature") > 0, sketch.bands(F.col("signature"), n, s["minhash_bands"])).otherwise(words_none),
        "chunks": F.when(F.col("simhash").isNotNull(), chunk).otherwise(words_none),
    })


def _sketch_schema(base: DataFrame, local: bool) -> StructType:
    kept = [f for f in base.schema.fields if not f.name.startswith("__")]
    bigints, doubles = ArrayType(LongType()), ArrayType(DoubleType())
    more = [("signature", bigints), ("simhash", LongType()), ("winnow", bigints)] + ([("text_embedding", doubles), ("diff_embedding", doubles)] if local else [])
    return StructType(kept + [StructField(name, kind) for name, kind in more])


def _sketches(s: dict[str, Any], dims: int | None):  # noqa: ANN202
    """Rows with __m (words of the sketches, null for none) and perhaps __t and __d (words of the embeddings) -> sketches."""

    def lists(starts, values) -> pa.ListArray:  # noqa: ANN001
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))

    def spread_out(place, size: int, counts) -> np.ndarray:  # noqa: ANN001
        out = np.zeros(size, np.int64)
        out[place] = counts
        return np.concatenate([[0], np.cumsum(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if not c.startswith("__")]
            material = batch.column("__m")
            place = np.flatnonzero(material.is_valid().to_numpy(zero_copy_only=False))
            words, n = material.take(pa.array(place)), s["minhash_permutations"]
            low, starts = sketch.winnowed(words, s["winnow_k"], s["winnow_window"])
            hashed = np.zeros(batch.num_rows, np.int64)
            hashed[place] = sketch.simhashes(words)
            lacks = np.ones(batch.num_rows, bool)
            lacks[place] = False
            columns = [
                lists(spread_out(place, batch.num_rows, n), sketch.minhashes(words, s["shingle_k"], n).ravel()),
                pa.array(hashed, mask=lacks),
                lists(spread_out(place, batch.num_rows, np.diff(starts)), low),
            ]
            names = [*kept, "signature", "simhash", "winnow"]
            for c, name in (("__t", "text_embedding"), ("__d", "diff_embedding")):
                if c in batch.schema.names:
                    columns.append(lists(np.arange(batch.num_rows + 1) * dims, sketch.embedded(batch.column(c), dims).ravel()))
                    names.append(name)
            yield pa.record_batch([batch.column(c) for c in kept] + columns, names)

    return run


def model_id(cfg: dict[str, Any]) -> str:
    """What vectors and sketches of a stored fingerprint were made by."""
    e = cfg["embedding"]
    return f"{e['provider']}:{e.get('model', '')}:{e.get('dims', '')}::2"


def cached_fingerprints(active: DataFrame, cfg: dict[str, Any], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of which those that the cache holds are taken from it, and the rows that were made anew, as cache rows.

    A row of the cache (repo, updated_at, model_id and the fingerprint) holds for the same revision and model, with a
    text embedding, title tokens and, where the settings weigh diffs, a diff embedding."""
    own = active.select("repo", F.col("id").alias("entity_id"), "updated_at")
    full = (F.size("text_embedding") > 0) & (F.size("title_tokens") > 0)
    if cfg["similarity"]["semantic_diff_share"] > 0:
        full &= F.size("diff_embedding") > 0
    key = ["repo", "entity_id", "updated_at"]
    hits = cache.where((F.col("model_id") == model_id(cfg)) & full).join(own, key, "left_semi").dropDuplicates(key)
    missing = active.join(hits.select("repo", F.col("entity_id").alias("id")), ["repo", "id"], "left_anti")
    fresh = materialise(fingerprints(missing, cfg), "fresh")
    rows = fresh.join(own, "entity_id").withColumn("model_id", F.lit(model_id(cfg)))
    return hits.select(*fresh.columns).unionByName(fresh), rows


def sketch_chunks(value: Column, width: int) -> Column:
    return chunks(value, sketch.SIMHASH_BITS, max(1, width * sketch.SIMHASH_BITS // 64))


def run(entities: DataFrame, cfg: dict[str, Any], as_of: Column, hooks: Hooks | None = None, cache: DataFrame | None = None) -> Report:
    """Every stage that later ones read is written to the shared folder. With a cache only fingerprints that it lacks are
    made; the report's ``fresh`` rows are what to put into it."""
    hooks, s = hooks or Hooks(), cfg["similarity"]
    filtered = materialise(hooks.run("after_low_pass", lowpass.apply(hooks.run("before_low_pass", entities), cfg, as_of)), "filtered")
    active = filtered.where("filter_state = 'pass'")
    active, fresh = hooks.run("before_fingerprint", active), None
    if cache is None:
        made = fingerprints(active, cfg)
    else:
        made, fresh = cached_fingerprints(active, cfg, cache)
    fp = materialise(hooks.run("after_fingerprint", made), "fingerprints")
    ids = materialise(global_index(fp.select("entity_id").distinct(), F.asc("entity_id")), "ids")
    best = candidates.best(fp, KEYS, {"file": s["max_file_bucket"], "module": s["max_module_bucket"]}, cfg, ids)
    pairs = candidates.hopeful(best, fp, ids, cfg)
    pairs = hooks.run("before_similarity", pairs)
    a = fp.select(F.col("entity_id").alias("entity_a"), F.col("lane").alias("kind_a"), F.struct(*_PAIR).alias("a"))
    b = fp.select(F.col("entity_id").alias("entity_b"), F.col("lane").alias("kind_b"), F.struct(*_PAIR).alias("b"))
    scored = scoring.edges(pairs.join(a, "entity_a").join(b, "entity_b"), cfg).select("entity_a", "entity_b", "tier", *METRICS)
    edges = materialise(hooks.run("after_similarity", scored), "edges")
    grouped = materialise(hooks.run("after_cluster", graph.clusters(fp.select(F.col("entity_id").alias("node")), hooks.run("before_cluster", edges), cfg)), "clusters")
    types = materialise(graph.number(graph.classify(grouped, edges)), "types")
    members = materialise(grouped.join(types.select("component", "cluster_id"), "component").select("cluster_id", F.col("node").alias("entity_id")), "members")
    weights = filtered.select(F.col("id").alias("entity_id"), "priority_weight")
    ranked = canonical.rank(hooks.run("before_canonical", canonical.scores(members, fp, edges, weights, cfg)), edges, cfg)
    decisions = materialise(hooks.run("after_canonical", ranked), "decisions")
    shadows = canonical.attach_shadows(members, fp, filtered.where("filter_state <> 'pass'"))
    routing = hooks.run("after_action", canonical.route(filtered, hooks.run("before_action", decisions), types, cfg))
    return Report(filtered, fp, edges, members, types, decisions, routing, shadows, fresh)
