"""What can go wrong, and the reasons by which rows are set aside."""


class GaugewellError(Exception):
    """Any error of this package."""


class PlanError(GaugewellError):
    """A plan or configuration that can't be run."""


class SchemaError(GaugewellError):
    """A required column is missing, or a known column has another type."""


class ClosedError(GaugewellError):
    """The engine was shut down and takes no more points."""


LATE, OVERFLOW, UNKNOWN_SKETCH, UNKNOWN_ENCODING, OTHER_PLAN, OTHER_SKETCH, OTHER_VERSION, UNREADABLE, OTHER_PARAMETERS = (
    "late_data", "series_cap_exceeded", "unknown_sketch_type", "unknown_encoding", "other_plan", "other_sketch_type", "unknown_schema_version", "unreadable_payload", "other_parameters",
)
