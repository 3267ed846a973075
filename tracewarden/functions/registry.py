"""Functions by name for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.findings import IMPERATIVES, MARKERS, SECOND_PERSON, TARGETS
from ..policy import INGRESS_VARIANTS
from ..sources.lines import flatten_json
from . import closure


class InspectText:
    """``SELECT * FROM inspect_text(text)``: layer, rule and evidence of what a text of untrusted origin shows."""

    def eval(self, text: str):
        if text is None:
            return
        raw = text.encode().partition(b"\0")[0]
        plain = closure.normalized(raw)
        if plain != raw:
            yield "normalize", "unicode-transform", plain.decode("utf-8", "replace")
        inner, depth = closure.unwrap(raw)
        if depth:
            yield "normalize", "transport-encoded", inner.decode("utf-8", "replace")
        elif found := closure.embedded(raw):
            yield "normalize", "embedded-encoded", found[0].decode("utf-8", "replace")
        lowered = [r.lower().decode("latin-1") for r in closure.readings(raw, INGRESS_VARIANTS)]
        for reading in lowered:
            for marker in MARKERS:
                if marker.lower() in reading:
                    yield "ingress", "chat-template-marker", marker
        addressed = any(p in r for r in lowered for p in SECOND_PERSON)
        commanded = any(any(v in r for v in IMPERATIVES) and any(x in r for x in TARGETS) for r in lowered)
        own = any(x in lowered[0] for x in ("my ", "our "))
        if addressed or commanded and not own:
            yield "ingress", "data-imperative", text


def register(spark: SparkSession) -> None:
    """Make the closure's functions and ``inspect_text`` known to a session's SQL."""
    for name in ("closure_readings", "embedded_decodes", "unwrapped", "folded"):
        spark.udf.register(name, getattr(closure, name))
    spark.udf.register("flatten_json", flatten_json)
    spark.udtf.register("inspect_text", udtf(InspectText, returnType="layer string, rule string, evidence string"))
