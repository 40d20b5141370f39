"""DataFrame to DataFrame operators on (date, ticker) panels."""
