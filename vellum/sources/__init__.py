"""Tables in the shared folder that change as one."""
