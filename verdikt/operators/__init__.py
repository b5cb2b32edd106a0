"""DataFrame operators: brackets, matching, identity, standings, ratings."""
