"""Errors with machine-readable codes and context."""

from __future__ import annotations


class TallyError(Exception):
    """Base of all errors; ``code`` names the kind and ``context`` holds what it is about."""

    code = "E000"

    def __init__(self, message: str = "", **context: object):
        super().__init__(message)
        self.context = context

    def __str__(self) -> str:
        about = ", ".join(f"{k}={v!r}" for k, v in sorted(self.context.items()))
        return f"[{self.code}] {super().__str__()}" + (f" ({about})" if about else "")


#: Codes are part of the interface. Fixed values.
_KINDS = {
    "E101": "InvalidConfigError",
    "E102": "MissingSeedError",
    "E103": "InvalidBackendModeError",
    "E104": "BudgetConservationError",
    "E201": "InvalidSpecError",
    "E202": "DataLoadError",
    "E203": "EmptyStreamError",
    "E204": "OracleUnavailableError",
    "E301": "InvalidSketchParameterError",
    "E302": "IndistinguishableBudgetError",
    "E303": "MergeTypeError",
    "E304": "MergeUnsupportedError",
    "E305": "SerializationError",
    "E306": "EstimateUnavailableError",
    "E401": "BackendMissingError",
    "E402": "BackendImportError",
    "E501": "DeterminismViolationError",
    "E502": "MetricOutOfBoundsError",
    "E503": "IndistinguishableCostError",
    "E505": "PipelineTimeoutError",
}


def registry_of(kinds: list[type[TallyError]]) -> dict[str, type[TallyError]]:
    """Errors by code; a code or a name that comes twice is a RuntimeError."""
    found: dict[str, type[TallyError]] = {}
    for kind in kinds:
        if not issubclass(kind, TallyError):
            raise RuntimeError(f"{kind!r} is no TallyError")
        if kind.code in found or kind.__name__ in {k.__name__ for k in found.values()}:
            raise RuntimeError(f"code or name comes twice: {kind.code} {kind.__name__}")
        found[kind.code] = kind
    return found


for _code, _name in _KINDS.items():
    globals()[_name] = type(_name, (TallyError,), {"code": _code, "__doc__": f"{_code}."})

BY_CODE = registry_of([globals()[name] for name in _KINDS.values()])


def error_class(code: str) -> type[TallyError]:
    return BY_CODE[code]
