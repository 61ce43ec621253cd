from veridelta.cli import main

raise SystemExit(main())
