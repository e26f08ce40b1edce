"""Model answers to scored, filtered predictions and result envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmatch.functions import variants as vr
from docmatch.functions.text import strip_fence

FIELDS = ["input_uid", "input_text", "ref_uid", "ref_text", "plain_text"]
UIDS = ["input_uid", "ref_uid"]
PREDICTION = [*FIELDS, "evidences", "start_end_idx", "confidence", "similarity_score", "extra"]


def parse_output(answers: DataFrame, raw: str = "raw_output") -> DataFrame:
    """One row per prediction, numbered from 0; columns of ``answers`` are carried along.

    A list gives its items. Text that is not JSON becomes one prediction with the text as
    ``plain_text`` and confidence 1; JSON other than a list gives nothing. ``item_status`` is
    ``bad_item`` for items that are not objects or whose confidence is not a number. Absent
    ``evidences`` and ``start_end_idx`` become empty lists, JSON null stays NULL. A uid that is not a
    string names nothing. All other keys of an item are kept as text in the map ``extra``.
    """
    carried = [c for c in answers.columns if c != raw]
    body = answers.where(F.col(raw).isNotNull()).withColumn("_body", strip_fence(F.col(raw)))
    parsed = body.withColumn("_json", F.try_parse_json("_body"))
    fallback = F.array(F.lit(None).cast("variant"))
    listed = F.when(F.col("_json").isNull(), fallback).otherwise(vr.items(F.col("_json")))
    rows = parsed.select(
        *carried, "_body", F.col("_json").isNull().alias("_plain"),
        F.posexplode(listed).alias("pred_no", "_item"),
    )
    item = F.col("_item")
    confidence = vr.field(item, "confidence")

    def list_field(name: str, kind: str) -> Column:
        return F.when(vr.field(item, name).isNull(), F.array().cast(kind)).otherwise(
            F.try_variant_get(item, f"$.{name}", kind)
        )

    good = F.col("_plain") | (
        F.coalesce(vr.is_object(item), F.lit(False)) & (confidence.isNull() | vr.is_number(confidence))
    )
    columns = {name: (vr.text_field if name in UIDS else vr.string_field)(item, name) for name in FIELDS}
    columns["plain_text"] = F.when(F.col("_plain"), F.col("_body")).otherwise(columns["plain_text"])
    columns["evidences"] = list_field("evidences", "array<string>")
    columns["start_end_idx"] = list_field("start_end_idx", "array<array<int>>")
    columns["confidence"] = F.when(F.col("_plain"), F.lit(1.0)).when(
        vr.is_number(confidence), F.try_variant_get(item, "$.confidence", "double")
    )
    columns["extra"] = vr.other_fields(item, lambda k: k.isin(*PREDICTION))
    columns["item_status"] = F.when(good, "ok").otherwise("bad_item")
    return rows.select(*carried, "pred_no", *[c.alias(n) for n, c in columns.items()])


def swap_reverse(predictions: DataFrame, leg: str = "leg") -> DataFrame:
    """Exchange the input and reference sides of predictions made in the reverse direction."""
    reverse = F.col(leg) == "reverse"
    pairs = [("input_uid", "ref_uid"), ("input_text", "ref_text")]
    swapped = {}
    for a, b in pairs:
        swapped[a] = F.when(reverse, F.col(b)).otherwise(F.col(a))
        swapped[b] = F.when(reverse, F.col(a)).otherwise(F.col(b))
    return predictions.withColumns(swapped)


def attach_scores(
    predictions: DataFrame, hits: DataFrame, keys: list[str], *, as_coded: bool = False
) -> DataFrame:
    """``similarity_score`` of each prediction from its query's hits, 0 where none matches.

    Looks up ``ref_uid`` and then ``input_uid``, since in reverse the hits are input rows;
    ``as_coded`` looks up ``ref_uid`` only. Of several hits with one uid the last counts. A query has
    at most k hits, so they travel as one short list per query and the predictions join once.
    """
    scores = hits.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "uid", "score"))).alias("_scores")
    )

    def score_of(uid: str) -> Column:
        same = F.filter("_scores", lambda s: s["uid"] == F.col(uid))
        return F.try_element_at(same, F.lit(-1))["score"]

    found = [score_of("ref_uid")]
    if not as_coded:
        found.append(score_of("input_uid"))
    joined = predictions.join(scores, keys, "left")
    return joined.withColumn("similarity_score", F.coalesce(*found, F.lit(0.0))).drop("_scores")


def filter_confidence(predictions: DataFrame, threshold: str | float = "cof_threshold") -> DataFrame:
    """Keep predictions at or above the threshold; a missing confidence counts as 0."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    return predictions.where(F.coalesce("confidence", F.lit(0.0)) >= limit)


def envelopes(answers: DataFrame, predictions: DataFrame, keys: list[str], head: list[str]) -> DataFrame:
    """One row per answered query with its predictions in order; queries whose predictions were all
    filtered keep an empty list.
    """
    lists = predictions.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pred_no", *[c for c in PREDICTION if c in predictions.columns])),
                     lambda a, b: a["pred_no"] - b["pred_no"]).alias("predictions")
    )
    joined = answers.select(*dict.fromkeys([*keys, *head])).join(lists, keys, "left")
    empty = F.array().cast(lists.schema["predictions"].dataType)
    return joined.withColumn("predictions", F.coalesce("predictions", empty))
