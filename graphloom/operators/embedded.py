"""Rules over evidence that nodes carry as JSON: parsed once into VARIANT values, checked by path and type.

Every rule is a column; a node's reasons come out of one pass over it after its medium and its source were joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import violations

SCOPE = ("build_id", "split", "dataset_revision")
#: What a model's candidate may be called, and what of a source its evidence may repeat.
SEMANTICS, REPEATED = ("model_candidate", "media_structure"), ("archive", "member", "artifact_path", "url")
_NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


class Json:
    """A VARIANT column with questions about its paths; a value that is no JSON has nothing at any path."""

    def __init__(self, value: Column):
        self.value = value

    @classmethod
    def of(cls, text: Column) -> Json:
        return cls(F.try_parse_json(text))

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.value, path, "variant")

    def kind(self, path: str = "$") -> Column:
        """The type's name; null where there is nothing."""
        return F.schema_of_variant(self.at(path))

    def has(self, path: str) -> Column:
        return self.at(path).isNotNull()

    def is_null(self, path: str) -> Column:
        """The path is there and holds null."""
        return F.coalesce(F.is_variant_null(self.at(path)), F.lit(False))

    def text(self, path: str) -> Column:
        """A string; null for all other types."""
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.value, path, "string"))

    def number(self, path: str) -> Column:
        """A finite number; null for all other types, truth values and strings included."""
        value = F.try_variant_get(self.value, path, "double")
        return F.when(self.kind(path).rlike(_NUMBERS) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)

    def filled(self, path: str) -> Column:
        return F.coalesce(F.trim(self.text(path)) != "", F.lit(False))

    def is_object(self, path: str = "$") -> Column:
        return F.coalesce(self.kind(path).startswith("OBJECT"), F.lit(False))

    def vector(self, path: str, size: int) -> Column:
        """Whether the path holds ``size`` finite numbers, not all of them zero."""
        items = F.try_variant_get(self.value, path, "array<variant>")
        good = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).rlike(_NUMBERS), F.lit(False)))
        values = F.try_variant_get(self.value, path, "array<double>")
        finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        return F.coalesce((F.size(items) == size) & good & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def evidence_violations(nodes: DataFrame, media: DataFrame, sources: DataFrame, scope: dict[str, str], dimensions: int = 512, run_label: str = "SemanticRun", media_labels: Sequence[str] = ("Image", "Video")) -> DataFrame:
    """(id, reason) for each rule that a new node of nodes(id, label, properties_json) breaks by what its JSON says.

    media(id, label, source_id) are the existing media, sources(id, archive, member, artifact_path, url and the scope's
    columns) where they come from. A node names its medium and the medium's own source, which is of the scope; its
    evidence is an object bound to both, of the scope, repeating nothing of the source otherwise. It is a candidate:
    verified is false, confidence is there and null, a similarity lies in -1..1, its model and semantics are known.
    Observations hold a vector and the model's output, frames and clips belong to a video and have times. Run
    nodes have no source. Properties that are no JSON object break 'properties' alone; null ids count as others.
    """
    run = F.col("label") == run_label
    of_run = ~(Json.of(F.col("properties_json")).has("$.source_media_id") | Json.of(F.col("properties_json")).has("$.source_id"))
    rows = nodes.select("id", "label", F.try_parse_json("properties_json").alias("v"))
    p = Json(F.col("v"))
    rows = rows.withColumns({"__medium": p.text("$.source_media_id"), "__source": p.text("$.source_id"), "__evidence": F.try_parse_json(p.text("$.evidence_json")), "__raw": F.try_parse_json(p.text("$.raw_json"))})
    known = media.where(F.col("label").isin(*media_labels)).select(F.col("id").alias("__medium"), F.col("label").alias("__kind"), F.col("source_id").alias("__own"))
    origin = sources.select(F.col("id").alias("__source"), F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in (*REPEATED, *SCOPE)])
    rows = rows.join(known, "__medium", "left").join(origin, "__source", "left")
    e, raw = Json(F.col("__evidence")), Json(F.col("__raw"))
    is_, optional = lambda *labels: F.col("label").isin(*labels), lambda json, path, test: ~json.has(path) | F.coalesce(test, F.lit(False))
    only = lambda labels, test: ~is_(*labels) | F.coalesce(test, F.lit(False))
    start, end = p.number("$.start_seconds"), p.number("$.end_seconds")
    rules = {
        "medium": F.col("__kind").isNotNull(),
        "source": F.col("__there") & (F.col("__own") == F.col("__source")),
        "source_scope": ~F.coalesce(F.col("__there"), F.lit(False)) | _all(F.col(f"__{c}") == F.lit(scope[c]) for c in SCOPE),
        "evidence": e.is_object(),
        "evidence_binding": ~e.is_object() | (e.text("$.source_media_id") == F.col("__medium")) & (e.text("$.source_id") == F.col("__source")),
        "evidence_scope": _all(optional(e, f"$.{c}", e.text(f"$.{c}") == F.lit(scope[c])) for c in SCOPE),
        **{f"evidence_{c}": optional(e, f"$.{c}", e.text(f"$.{c}") == F.col(f"__{c}")) | ~F.coalesce(F.col("__there"), F.lit(False)) for c in REPEATED},
        "scope": _all(optional(p, f"$.{c}", p.text(f"$.{c}") == F.lit(scope[c])) for c in SCOPE),
        "verified": (p.kind("$.verified") == "BOOLEAN") & (F.try_variant_get(p.value, "$.verified", "boolean") == F.lit(False)),
        "semantics": p.text("$.semantics").isin(*SEMANTICS),
        "model": p.filled("$.model"),
        "confidence": p.is_null("$.confidence"),
        "similarity": optional(p, "$.similarity_score", p.number("$.similarity_score").between(-1, 1)),
        "embedding": only(["VisualObservation"], p.vector("$.embedding", dimensions)),
        "embedding_model": only(["VisualObservation"], p.filled("$.embedding_model")),
        "raw_output": only(["VisualObservation"], raw.is_object()),
        "video": only(["Frame", "VideoClip"], F.col("__kind") == "Video"),
        "frame_time": only(["Frame"], p.number("$.timestamp_seconds") >= 0),
        "clip_times": only(["VideoClip"], (start >= 0) & (end > start)),
    }
    of_runs = violations(nodes.where(run & Json.of(F.col("properties_json")).is_object()), "id", {"run_source": of_run})
    objects = p.is_object()
    checked = violations(rows.where(~F.coalesce(run, F.lit(False)) & objects), "id", rules)
    return checked.union(of_runs).union(violations(rows.where(~objects), "id", {"properties": F.lit(False)}))


def _all(tests) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & F.coalesce(test, F.lit(False))
    return out
