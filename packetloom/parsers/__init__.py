"""Parsers of application protocols; importing this registers those that come with the library."""

from packetloom.parsers import dns, http, quic, ssh, tls  # noqa: F401
from packetloom.parsers.base import PARSERS, Parser, Probe, Prober, register

__all__ = ["PARSERS", "Parser", "Probe", "Prober", "register"]
