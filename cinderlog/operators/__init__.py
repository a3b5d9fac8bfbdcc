"""DataFrame to DataFrame operators. Time always comes in as an argument (`as_of`)."""
