"""Where flight records come from."""

from .raw import bad_rows, flights_from_lines, header_ordinals, read_flights, read_flights_strict, wide_lines
from .staging import load_raw_lines, unzip_csv
from .streams import directory_lines, kafka_lines, socket_lines
from .tables import TABLES, Tables
from .wire import flights_from_wire, flights_from_wire_compat, to_wire

__all__ = ["TABLES", "Tables", "bad_rows", "directory_lines", "flights_from_lines", "flights_from_wire", "flights_from_wire_compat", "header_ordinals", "kafka_lines", "load_raw_lines", "read_flights", "read_flights_strict", "socket_lines", "to_wire", "unzip_csv", "wide_lines"]
