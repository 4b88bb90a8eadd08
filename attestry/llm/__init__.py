"""Training-data operators: each module holds one operator; queries.py and oracles.py register them."""
