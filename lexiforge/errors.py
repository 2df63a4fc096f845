"""Errors, one family for each part."""


class CorpusError(Exception):
    """Any error of this package."""


class ConfigError(CorpusError): ...


class ScanError(CorpusError): ...


class ParseError(CorpusError): ...


class EmbedError(CorpusError): ...


class CollectionError(CorpusError): ...


class QueryError(CorpusError): ...


class ValidationError(CorpusError):
    """An input that breaks a rule."""


class ModelError(CorpusError):
    """A call of a model that failed."""


class RateLimited(ModelError):
    """The model asks to be called later: after retry_after seconds, if it says so."""

    def __init__(self, message: str = "", endpoint: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.endpoint, self.retry_after = endpoint, retry_after


class StoreUnreachable(CollectionError):
    """The collection's folder can't be reached."""


class DocumentMissing(CollectionError):
    """A document that the collection doesn't have."""


class RemovalError(CollectionError):
    """A removal that failed; what it left behind may have to be cleaned up."""

    def __init__(self, message: str, requires_cleanup: bool = False, document_id: str | None = None):
        super().__init__(message)
        self.requires_cleanup, self.document_id = requires_cleanup, document_id
