"""Exceptions of scanning, decoding and reshaping."""

from __future__ import annotations


class LogError(Exception):
    """Base of all errors raised by this package."""


class ContainerError(LogError):
    """The file is no valid container: bad magic, truncated record, checksum mismatch."""


class SummaryNotAvailable(LogError):
    def __init__(self) -> None:
        super().__init__("MCAP summary not available")


class StatsNotAvailable(LogError):
    def __init__(self) -> None:
        super().__init__("MCAP summary stats not available")


class SchemaNotAvailable(LogError):
    def __init__(self) -> None:
        super().__init__("schema not available")


class TopicNotFound(LogError):
    def __init__(self) -> None:
        super().__init__("topic not found")


class MultipleChannels(LogError):
    def __init__(self) -> None:
        super().__init__("multiple channels found for requested topic")


class NoDecoder(LogError):
    def __init__(self, schema_encoding: str, message_encoding: str) -> None:
        super().__init__(f"no decoder registered for schema_encoding='{schema_encoding}', message_encoding='{message_encoding}'")
        self.schema_encoding, self.message_encoding = schema_encoding, message_encoding

    def __reduce__(self):
        return type(self), (self.schema_encoding, self.message_encoding)


class EmptyDerivedSchema(LogError):
    def __init__(self, schema_name: str) -> None:
        super().__init__(f"failed to derive schema (schema: '{schema_name}')")
        self.schema_name = schema_name

    def __reduce__(self):
        return type(self), (self.schema_name,)


class DecoderError(LogError):
    """Base of what a decoder reports."""


class SchemaParse(DecoderError):
    def __init__(self, detail: object) -> None:
        super().__init__(f"failed to parse schema: {detail}")


class SchemaDerivation(DecoderError):
    def __init__(self, detail: object) -> None:
        super().__init__(f"schema derivation failed: {detail}")


class MessageDecode(DecoderError):
    def __init__(self, detail: object) -> None:
        super().__init__(f"failed to decode message: {detail}")


class ConvertError(LogError):
    """A decoded value does not fit the schema."""


class EmptyRows(ConvertError):
    def __init__(self) -> None:
        super().__init__("Cannot create RecordBatch from empty rows")


class MetadataColumnCollision(ConvertError):
    def __init__(self, names: list[str]) -> None:
        super().__init__(f"metadata columns [{', '.join(names)}] collide with payload fields; set a metadata prefix to disambiguate")
        self.names = names

    def __reduce__(self):
        return type(self), (self.names,)


class ValueTypeError(ConvertError):
    def __init__(self, expected: str, actual: str) -> None:
        super().__init__(f"value type mismatch: expected {expected}, got {actual}")


class CallbackError(LogError):
    """An error of the caller's own function, wrapped once; it ends the scan."""

    def __init__(self, cause: BaseException) -> None:
        super().__init__(str(cause))
        self.__cause__ = cause


class ProjectionError(LogError):
    pass


class FlattenError(LogError):
    pass


class SinkError(LogError):
    pass
