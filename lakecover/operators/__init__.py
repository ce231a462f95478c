"""DataFrame operators; each works on any table with an id and a group key."""
