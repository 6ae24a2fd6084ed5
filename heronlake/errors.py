"""Errors of the engine."""


class LakeError(Exception):
    """Base of all errors."""


class DecodeError(LakeError):
    pass


class CorruptIndex(LakeError):
    pass


class ReservedCollection(LakeError):
    """Names that begin with two underscores are the engine's own."""


class InvalidName(LakeError):
    pass


class InvalidArgument(LakeError):
    pass


class IncompatibleFormat(LakeError):
    pass


class EmptyIndexTraining(LakeError):
    """No vectors to train on, or a dimension that doesn't divide."""


class SchemaViolation(LakeError):
    pass


class InvalidDump(LakeError):
    pass


class BackupTargetExists(LakeError):
    pass


class StorageError(LakeError):
    pass
