"""Column contracts shared by every operator.

Ids may be of any orderable type; only ids that reach a learned model are dictionary-encoded
(see ``operators.indexing``).
"""

from pyspark.sql import types as T

# One raw review line. ``overall`` and ``verified`` arrive as text or as JSON scalars, so both are
# read as strings and cast later; a DOUBLE here would turn "4.0" into a corrupt row.
RAW_REVIEW = T.StructType(
    [
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("overall", T.StringType()),
        T.StructField("reviewText", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("verified", T.StringType()),
        T.StructField("style", T.MapType(T.StringType(), T.StringType())),
        T.StructField("reviewerName", T.StringType()),
    ]
)

ITEM_METADATA = T.StructType(
    [
        T.StructField("asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
    ]
)
