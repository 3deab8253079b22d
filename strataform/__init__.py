"""Tables made by people, turned into typed, linked, checked records with Spark."""
