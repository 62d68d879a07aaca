"""One view over record tables: JSON text with free keys, or typed columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.operators.profile import numeric_columns


class RecordView:
    """Records whose keys can be asked for; ``df`` holds the columns the answers refer to."""

    df: DataFrame

    def has_keys(self, keys: Sequence[str]) -> Column:
        raise NotImplementedError

    def any_key(self, test: Callable[[Column], Column]) -> Column:
        raise NotImplementedError

    def key_count(self) -> Column:
        raise NotImplementedError

    def text(self, key: str) -> Column:
        """The value as text, null when absent or null."""
        raise NotImplementedError

    def kind(self, key: str) -> Column:
        """absent, null, text, number, boolean or nested."""
        raise NotImplementedError


class JsonRecords(RecordView):
    """JSON objects in a text column. Text that is no object counts as a record without keys.

    Each record is split into a map of its values' own JSON text once; a value's first
    character tells its kind, so that ``80`` and ``"80"`` stay apart.
    """

    _ASKED = ["destination_port", "label", "ml_confidence_score", "ml_model_version"]

    def __init__(self, df: DataFrame, value: str = "value"):
        text = F.col(value)
        parsed = F.try_parse_json(text)
        kinds = [
            F.lower(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))).alias(k)
            for k in self._ASKED
        ]
        values = [F.get_json_object(text, f"$.{k}").alias(k) for k in self._ASKED]
        self.df = df.where(F.trim(text) != "").select(
            F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")).alias("_keys"),
            F.struct(*kinds).alias("_kinds"),
            F.struct(*values).alias("_values"),
        )

    def has_keys(self, keys: Sequence[str]) -> Column:
        found = F.lit(True)
        for k in keys:
            found = found & F.array_contains("_keys", F.lit(k))
        return found

    def any_key(self, test: Callable[[Column], Column]) -> Column:
        return F.exists("_keys", test)

    def key_count(self) -> Column:
        return F.size("_keys")

    def text(self, key: str) -> Column:
        return F.col(f"_values.{key}")

    def kind(self, key: str) -> Column:
        kind = F.col(f"_kinds.{key}")
        return (
            F.when(kind.isNull(), F.lit("absent"))
            .when(kind == "void", F.lit("null"))
            .when(kind == "string", F.lit("text"))
            .when(kind == "boolean", F.lit("boolean"))
            .when(kind.startswith("array") | kind.startswith("object"), F.lit("nested"))
            .otherwise(F.lit("number"))
        )


class TableRecords(RecordView):
    """A typed table: its column names are the keys of every record."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._types = dict(df.dtypes)
        self._numeric = set(numeric_columns(df))

    def has_keys(self, keys: Sequence[str]) -> Column:
        return F.lit(set(keys) <= set(self._types))

    def any_key(self, test: Callable[[Column], Column]) -> Column:
        names = F.array(*[F.lit(c) for c in self._types])
        return F.exists(names, test)

    def key_count(self) -> Column:
        return F.lit(len(self._types))

    def text(self, key: str) -> Column:
        return F.col(f"`{key}`").cast("string") if key in self._types else F.lit(None).cast("string")

    def kind(self, key: str) -> Column:
        if key not in self._types:
            return F.lit("absent")
        dtype = self._types[key]
        present = (
            "text" if dtype == "string" else "number" if key in self._numeric
            else "boolean" if dtype == "boolean" else "nested"
        )
        return F.when(F.col(f"`{key}`").isNull(), F.lit("null")).otherwise(F.lit(present))


class CleanedRecords(TableRecords):
    """A cleaned table, asked about the records it came from.

    Cleaning leaves the texts it refused, the critical keys that were missing, the odd keys and the number
    of keys beside the typed values. A table without these columns answers by its schema.
    """

    _FACTS = ("refused", "missing_keys", "odd_keys", "field_count", "extra")

    def __init__(self, df: DataFrame):
        super().__init__(df)
        self._facts = set(self._FACTS) & set(df.columns)
        self._types = {c: t for c, t in self._types.items() if c not in self._facts}

    def _refused_text(self, key: str) -> Column:
        if "refused" not in self._facts:
            return F.lit(None).cast("string")
        return F.get(F.filter("refused", lambda z: z["field"] == key), F.lit(0))["text"]

    def has_keys(self, keys: Sequence[str]) -> Column:
        if "missing_keys" not in self._facts:
            return super().has_keys(keys)
        return ~F.arrays_overlap("missing_keys", F.array(*[F.lit(k) for k in keys]))

    def any_key(self, test: Callable[[Column], Column]) -> Column:
        return F.exists("odd_keys", test) if "odd_keys" in self._facts else super().any_key(test)

    def key_count(self) -> Column:
        return F.col("field_count") if "field_count" in self._facts else super().key_count()

    def text(self, key: str) -> Column:
        return F.coalesce(self._refused_text(key), super().text(key))

    def kind(self, key: str) -> Column:
        return F.when(self._refused_text(key).isNotNull(), F.lit("text")).otherwise(super().kind(key))
