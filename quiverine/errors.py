"""Exceptions of the engine."""


class VectorEngineError(Exception):
    """Bad input, a missing file, or something else that a call can't go on with."""


class CapabilityError(VectorEngineError, RuntimeError):
    """An operation that the chosen search strategy doesn't support; raised before anything changes."""


class MultimodalError(VectorEngineError):
    def __init__(self, message: str) -> None:
        super().__init__(f"Multimodal: {message}")
