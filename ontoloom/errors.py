"""Typed failures, each with a stable code. The codes."""


class ProjectionError(Exception):
    code = "PROJECTION_ERROR"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class UnsupportedProfile(ProjectionError):
    code = "UNSUPPORTED_PROFILE"


class InvalidOptions(ProjectionError, ValueError):
    code = "INVALID_PROJECTION_OPTIONS"


class UnsupportedAxiomShape(ProjectionError):
    code = "UNSUPPORTED_AXIOM_SHAPE"


class BackendUnavailable(ProjectionError):
    code = "NATIVE_BACKEND_UNAVAILABLE"


class IncompatibleSource(ProjectionError):
    code = "SNAPSHOT_COMPATIBILITY"


class ResourceLimit(ProjectionError):
    code = "PROJECTION_RESOURCE"


class Cancelled(ProjectionError):
    code = "PROJECTION_CANCELLED"


class Nonconformance(ProjectionError, AssertionError):
    code = "CONSUMER_CONFORMANCE"


class ProjectionWarning(UserWarning):
    pass
