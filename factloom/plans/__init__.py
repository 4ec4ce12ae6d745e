"""The registered queries of factloom; importing this registers all of them in catalogue."""

from . import answers, catalogue, code, passes, talk  # noqa: F401
