"""The analytic questions as DataFrame -> DataFrame functions, for batch frames and, where said, for streams."""

from .best_flights import best_flights, lookup, messages_best, pick_keys, two_leg_trips
from .delays import coded, endpoint_counts, mean_delay, mean_delay_cents, selected, selected_pairs
from .ranking import first_per_count, first_token_counts, rank_all, smallest, smallest_per, top, top_list_per
from .stats import best_power_law, ccdf, fit_lognormal, fit_power_law, likelihood_ratio, log_sf, lognormal_whole, power_law_alpha, power_law_scan, ratio
from .words import word_counts

__all__ = ["best_flights", "best_power_law", "ccdf", "coded", "endpoint_counts", "first_per_count", "first_token_counts", "fit_lognormal", "fit_power_law", "likelihood_ratio", "log_sf", "lognormal_whole", "lookup", "mean_delay", "mean_delay_cents", "messages_best", "pick_keys", "power_law_alpha", "power_law_scan", "rank_all", "ratio", "selected", "selected_pairs", "smallest", "smallest_per", "top", "top_list_per", "two_leg_trips", "word_counts"]
