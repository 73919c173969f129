"""What can go wrong, for callers that tell kinds apart. A capture that cannot be read is a row of sources.capture.errors(), not an error."""


class AnalysisError(Exception):
    """Any error of this package."""


class ConfigurationError(AnalysisError):
    """A setting that cannot be used."""


class RuleError(AnalysisError):
    """A rule file that cannot be read."""


class DecoderError(AnalysisError):
    """An unknown protocol."""


class ExportError(AnalysisError):
    """A result that cannot be written."""
