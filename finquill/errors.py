"""Errors of document processing; each has a code that jobs and reports carry."""

from __future__ import annotations


class DocumentError(Exception):
    code = "document_processing_error"


class UnsupportedFormat(DocumentError):
    code = "unsupported_format"


class EmptyDocument(DocumentError):
    code = "empty_document"


class OcrFailure(DocumentError):
    code = "ocr_failure"


class ModelTimeout(DocumentError):
    code = "llm_timeout"


class QuotaExceeded(DocumentError):
    """The service refuses for want of quota; another try can't help."""

    code = "llm_quota_exceeded"


class JsonFailure(DocumentError):
    code = "json_parse_failure"


class WorkbookFailure(DocumentError):
    code = "excel_generation_failure"


CODES = {e.code: e for e in (DocumentError, UnsupportedFormat, EmptyDocument, OcrFailure, ModelTimeout, QuotaExceeded, JsonFailure, WorkbookFailure)}
