"""Fixed schemas of the records that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T




RANGE = "STRUCT<documentId STRING, start INT, end INT, content STRING>"
CODE_RANGE = "STRUCT<filename STRING, start INT, end INT, content STRING>"

DDL = {
    "projects": (
        "project_name STRING, project_location STRING, create_time TIMESTAMP_NTZ, code_repo STRING, doc_repo STRING, "
        "code_files ARRAY<STRING>, doc_files ARRAY<STRING>, code_scale BIGINT"
    ),
    "history": "name STRING, path STRING, last_opened TIMESTAMP_NTZ",
    "files": "project STRING, path STRING, kind STRING, content STRING",
    "code_lines": "file STRING, line_no INT, text STRING",
    "req_points": (
        "doc STRING, seq INT, type STRING, id STRING, content STRING, cells MAP<STRING, STRING>, context STRING, "
        "context_path ARRAY<STRING>"
    ),
    "chunks": "file STRING, chunk_no INT, start_line INT, end_line INT, content STRING",
    "llm_replies": "requirement_id STRING, file STRING, chunk_no INT, reply STRING",
    "related_code": "requirement_id STRING, filename STRING, content STRING, start INT, end INT",
    "alignments": (
        "project STRING, doc STRING, id STRING, name STRING, isReviewed BOOLEAN, reviewThoughts STRING, "
        f"docRanges ARRAY<{RANGE}>, codeRanges ARRAY<{CODE_RANGE}>"
    ),
    "issues": (
        "id STRING, level STRING, summary STRING, description STRING, status STRING, alignmentId STRING, "
        "relatedDocFile STRING, relatedRequirementId STRING, createdDate TIMESTAMP, updatedDate TIMESTAMP"
    ),
    "annotations": (
        f"id STRING, category STRING, docRanges ARRAY<{RANGE}>, codeRanges ARRAY<{RANGE}>, updateTime TIMESTAMP"
    ),
    "annotation_files": (
        "id STRING, name STRING, content STRING, type STRING, renderedDocument STRING, lastModified TIMESTAMP, localPath STRING"
    ),
    "review_points": (
        f"id STRING, text STRING, relatedCode ARRAY<{CODE_RANGE}>, state STRING, reviewProcess STRING, issues STRING, "
        "generatedRequirement STRING"
    ),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
