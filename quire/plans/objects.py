"""Objects of document files, made here from the documents table and parsed back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query, table
from quire.sources import reader
from quire.sources.objects import Name, Ref, write_document


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document file for each row: catalogue, page, compressed content."""
    from quire.functions.codecs import CODECS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = CODECS["FlateDecode"][0]
        for batch in batches:
            files = [
                write_document(
                    {
                        1: ({"Type": Name("Catalog"), "Pages": Ref(2, 0), "Lang": lang.encode()}, None),
                        2: ({"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, None),
                        3: ({"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "MediaBox": [0, 0, 612, 792.5]}, None),
                        4: ({"Filter": Name("FlateDecode")}, pack(text.encode())),
                    },
                    1,
                )
                for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text").mapInArrow(make, "doc_id bigint, content binary")


@query(
    """SELECT doc_id, 1 AS obj_num, 'dict' AS kind, 'Catalog' AS type, CAST(NULL AS VARCHAR) AS sha FROM documents UNION ALL SELECT doc_id, 2, 'dict', 'Pages', NULL FROM documents
    UNION ALL SELECT doc_id, 3, 'dict', 'Page', NULL FROM documents UNION ALL SELECT doc_id, 4, 'stream', NULL, sha256(text) FROM documents"""
)
def file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indirect objects with their decoded contents."""
    objects = reader.parse_documents(_files(spark, sf_dir), "doc_id", "bigint")
    return objects.select("doc_id", "obj_num", "kind", "type", F.sha2("content", 256).alias("sha"))


@query(
    """SELECT doc_id, src, field, dst FROM documents, (VALUES (1, '/Pages', 2), (2, '/Kids', 3), (3, '/Parent', 2), (3, '/Contents', 4)) e(src, field, dst)"""
)
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between the objects."""
    return reader.edges(reader.parse_documents(_files(spark, sf_dir), "doc_id", "bigint"), "doc_id")


@query("SELECT coalesce(type, 'stream') AS type, CAST(count(*) * 1 AS BIGINT) AS n FROM (SELECT unnest(['Catalog', 'Pages', 'Page', 'stream']) AS type FROM documents) t GROUP BY 1")
def file_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by type."""
    objects = reader.parse_documents(_files(spark, sf_dir), "doc_id", "bigint")
    return objects.groupBy(F.coalesce("type", "kind").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, source || ' of ' || lang AS title FROM documents")
def xmp_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as XML, written and read."""
    xml = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><rdf:Description><dc:language>'), F.col("lang"), F.lit("</dc:language><dc:title>"),
        F.concat_ws(" of ", "source", "lang"), F.lit("</dc:title></rdf:Description></rdf:RDF>"),
    )
    df = table(spark, sf_dir, "documents").select("doc_id", xml.alias("x"))
    at = lambda name: F.xpath_string("x", F.lit(f"//*[local-name()='{name}']"))
    return df.select("doc_id", at("language").alias("lang"), at("title").alias("title"))
