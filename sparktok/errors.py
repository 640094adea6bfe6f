"""What can go wrong, each with the exit status that the command line gives for it."""


class TokError(Exception):
    """Base of all; code is the number of the kind, exit_status what the command line ends with."""

    code, exit_status = 0, 1


class InputError(TokError):
    """A file can't be read, or is too short to be what it should be."""

    code, exit_status = -1, 2


class FormatError(TokError):
    """A vocabulary breaks a rule of its format, or a source asks for what isn't supported."""

    code, exit_status = -2, 3


class RangeError(TokError):
    """A token id is out of range, or has no bytes."""

    code, exit_status = -3, 4


class ArgumentError(TokError):
    code, exit_status = -5, 1


MESSAGES = {0: "ok", -1: "input can't be read", -2: "not a valid vocabulary", -3: "token id out of range", -4: "out of memory", -5: "invalid argument"}


def describe(code: int) -> str:
    """The message of a code; of an unknown one as well."""
    return MESSAGES.get(code, "unknown error")
