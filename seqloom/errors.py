"""Errors of sources and combinations."""


class SeqloomError(Exception):
    """Base of all errors raised here."""


class FastxFormatError(SeqloomError):
    """A file is neither FASTA nor FASTQ, is empty, or isn't of the format that was asked for."""


class InvalidHeaderError(SeqloomError):
    pass


class InvalidSeparatorError(SeqloomError):
    pass


class UnequalLengthsError(SeqloomError):
    pass


class LengthMismatchError(SeqloomError):
    """Files that are read in step have different numbers of records."""


class ArityError(SeqloomError):
    """A file's number of records isn't a multiple of the group size."""


class CollectionSizeMismatchError(SeqloomError):
    def __init__(self, arity: int, found: int):
        super().__init__(f"collection of arity {arity} with {found} files")
        self.arity, self.found = arity, found


class MateError(SeqloomError):
    """Two alignments aren't the mates of a template."""


class ConfigurationError(SeqloomError):
    """The session lacks a setting that a cluster needs."""


class UrlError(SeqloomError):
    pass


class RemoteError(SeqloomError):
    """A remote file's transport failed."""


#: What `_error` holds in PERMISSIVE mode, and what FAILFAST raises for it.
RECORD_ERRORS = {"INVALID_HEADER": InvalidHeaderError, "INVALID_SEPARATOR": InvalidSeparatorError, "UNEQUAL_LENGTHS": UnequalLengthsError}
