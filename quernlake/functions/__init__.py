"""Types, scalar functions and aggregates of the dialect as Column builders."""
