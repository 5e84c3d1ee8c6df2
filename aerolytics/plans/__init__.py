"""The flight-shaped view over the star schema."""

from .flights_view import FLIGHTS_SQL, REGION_MONTH_SQL, flights, flights_by_region, flights_over, lineitem_of_year

__all__ = ["FLIGHTS_SQL", "REGION_MONTH_SQL", "flights", "flights_by_region", "flights_over", "lineitem_of_year"]
