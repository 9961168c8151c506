"""Types and fixed domains of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A memory item: a photo, a video or an email as text. item_ord is its place in the corpus and breaks ties.
ITEM = struct(item_id=S, modality=S, text=S, image_path=S, video_path=S, metadata=T.MapType(S, S), item_ord=L)
ENTITY = struct(entity=S, type=S)
#: A captioned photo or video.
MEDIA = struct(
    image_path=S, video_path=S, timestamp=S, location=T.ArrayType(D), location_name=S, city=S, caption=S, short_caption=S, tags=T.ArrayType(S),
    entities=T.ArrayType(ENTITY), ocr_text=S, safety_content=S, camera_settings=T.MapType(S, D), file_size=L, processed_at=S, model_used=S,
)
EMAIL = struct(id=S, timestamp=S, short_summary=S, detail=S, subject=S, sender=S, location=S, conversational_text=S)
QA = struct(id=S, question=S, answer=S, evidence_ids=T.ArrayType(S), qtype=S, notes=S, niah_evidence_ids=T.ArrayType(S))
CONSTRAINTS = struct(start=T.DateType(), end=T.DateType(), locations=T.ArrayType(S), today=T.DateType())
RANKED = struct(qa_id=S, item_id=S, score=D, rank=T.IntegerType())
USAGE = struct(input=L, output=L, total=L, cache_read=L, cache_creation=L, uncached=L, reasoning=L, cost=D)

#: The domains that summaries range over, and the cut-offs of recall.
QTYPES = ("number", "list_recall", "open_end")
MODALITIES = ("email", "image", "video")
KS = (1, 5, 10, 25, 50, 100, 200)
#: The weight of the recall at each cut-off in the composite score.
COMPOSITE = {1: 0.10, 5: 0.15, 10: 0.25, 25: 0.20, 50: 0.15, 100: 0.10, 200: 0.05}
