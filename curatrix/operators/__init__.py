"""DataFrame to DataFrame operators: allocation, sampling, mixing, splitting, cleaning, scoring, geometry and documents."""
