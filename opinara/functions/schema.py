"""Closed vocabularies and tables of weights of the data model."""

from __future__ import annotations

# Fixed values.
ASPECTS = ["restaurant_general", "restaurant_prices", "food_quality", "food_prices", "food_style_options", "drinks_quality", "drinks_prices", "drinks_style_options", "ambience", "service", "location"]
POLARITIES = ["positive", "negative", "neutral", "conflict"]
HARD_ASPECTS = ["restaurant_prices", "food_prices", "food_style_options", "drinks_quality", "drinks_prices", "drinks_style_options", "location"]
PRIORITY_WEIGHTS = {"restaurant_prices": 2.5, "food_prices": 2.0, "food_style_options": 2.0, "ambience": 1.8, "drinks_style_options": 2.5, "drinks_quality": 1.5, "location": 1.2, "restaurant_general": 1.0, "food_quality": 1.0, "service": 0.6}
BUCKET_QUOTAS = {"price_value_boundary": 56, "food_style_options_boundary": 36, "ambience_location_service_boundary": 30, "drinks_rare_aspects": 24, "neutral_conflict_polarity": 40, "hard_negatives_empty": 14, "natural_regularizers": 20}
TASK_MARKERS = ["aspect:", "sentiment:", "gold:", "json", "label", "annotation", "polarity", "restaurant_general", "food_quality", "food_style_options", "drinks_style_options"]
MARKUP = ["```", "\n-", "\n*", "{", "}"]
MMR_LAMBDA = {1: 1.00, 2: 0.88, 4: 0.80, 6: 0.76, 8: 0.72, 10: 0.70, 12: 0.68}
MMR_LAMBDA_OTHER = 0.72
